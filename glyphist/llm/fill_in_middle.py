"""Fill-in-the-middle: texts cut at two units and put in another order, as Arrow list operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.llm.texts import slices

# A unit is a run of letters or any other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_NOTHING = pa.scalar("", pa.large_string())


def _hash_parts(key: Column) -> list[Column]:
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _unused_character(texts: pa.Array) -> str:
    """A character that none of the texts has, the control character 31 if possible."""
    for point in (31, *range(1, 31), *range(0xE000, 0xD7FF + 0x100000)):
        if not 0xD800 <= point < 0xE000 and not pc.any(pc.match_substring(texts, chr(point)), min_count=0).as_py():
            return chr(point)
    raise ValueError("every character is in use")


def _lists_of(pieces: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pieces)


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Units of each text, and its prefix, middle and suffix.

    The prefix ends after the smaller of ``first`` and ``second`` modulo the units plus one,
    the middle after the larger. Units are marked by a character foreign to all texts, split
    there into lists, flattened with the number of their text, told apart by their ordinal,
    and joined again by part.
    """
    mark = _unused_character(texts)
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, r"\0" + mark), mark)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # The last entry of each list is the nothing behind the last mark.
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    begins = pa.array(np.concatenate([[0], np.cumsum(n.to_numpy() + 1)])[:-1])
    ordinals = pc.subtract(pa.array(np.arange(len(units))), begins.take(parents))
    ends = n.to_numpy() + 1
    a, b = first.to_numpy() % ends, second.to_numpy() % ends
    low, high = np.minimum(a, b), np.maximum(a, b)
    after_low = pc.greater_equal(ordinals, pa.array(low).take(parents))
    after_high = pc.greater_equal(ordinals, pa.array(high).take(parents))
    inside = pc.less(ordinals, n.take(parents))
    roles = [
        (pc.invert(after_low), low),
        (pc.and_not(after_low, after_high), high - low),
        (pc.and_(after_high, inside), n.to_numpy() - high),
    ]
    return n, [pc.binary_join(_lists_of(units.filter(role), counts), _NOTHING) for role, counts in roles]


def transformed(texts: pa.Array, h: list[pa.Array]) -> dict[str, pa.Array]:
    n, (prefix, middle, suffix) = cut(texts, h[0], h[1])
    marked = pc.match_substring(texts, PREFIX)
    for marker in (SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, marker))
    untouched = pc.greater_equal(pa.array(h[2].to_numpy() % 100), PLAIN_FROM)
    plain = pc.or_(pc.or_(marked, untouched), pc.equal(n, 0))
    suffix_first = pc.less(pa.array(h[3].to_numpy() % 100), SPM_BELOW)
    p, s, m = (pa.scalar(marker, pa.large_string()) for marker in (PREFIX, SUFFIX, MIDDLE))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, _NOTHING)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, _NOTHING)
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.if_else(plain, texts, pc.if_else(suffix_first, spm, psm)),
    }


def _transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _ in slices(batch, "text"):
            texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
            made = transformed(texts, [part.column(f"h{i}") for i in range(1, 5)])
            made["output"] = made["output"].cast(pa.string())
            columns = {"doc_id": part.column("doc_id"), **made}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    Cuts and form follow the SHA-256 of ``salt`` and the decimal id, so equal rows have equal
    results in any order and at any size; a null id is hashed as no digits. Null and empty
    texts, and those with a marker, stay plain; plain rows have no prefix or middle. An empty
    table gives no rows; other columns are not read. Texts of any length are handled whole,
    in slices of about a megabyte, a longer one alone.
    """
    key = F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_hash_parts(key))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transform, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from.

    No marker is in a text that was cut, and none can begin inside another, so each is
    found once.
    """
    end = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substr(F.substring_index(front, SUFFIX, 1), F.lit(4)), end, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), end, F.substr(F.substring_index(front, PREFIX, 1), F.lit(4)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
