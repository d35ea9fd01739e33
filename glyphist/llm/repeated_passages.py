"""Removal of byte strings that occur twice: prefix doubling over sampled positions.

Every string of ``length`` bytes is named by the least hashed 64-byte gram inside it, its
anchor, which its own bytes decide; equal strings have equal anchors at equal places. So
only anchors, about two in 340 positions, are ranked first, by their gram. Positions whose
rank is unique drop out. The others are ranked again by ever longer pieces of the strings
they stand for (64, then 337, 393 and all 400 bytes), a block of neighbouring positions at
a time, until a block's rank is unique (no string of it repeats), a block as a whole is
equal to another (all repeat), or the threshold is reached.

Ranks are 128-bit names of the bytes, not numbers in sorted order: only equality is asked,
and equal names meet in a shuffle with two numbers per name, never as a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.llm.steps import Steps
from glyphist.llm.texts import Spans, Texts, all_slices, words_of

LENGTH = 400
GRAM = 64
# Sizes of the blocks of positions that are ranked together, the last 1.
BLOCKS = (64, 8, 1)
# Words whose bytes name a window of words first.
WORD_GRAM = 8
PASSAGE_WORDS = 51
# Longer texts are read in pieces of this size that overlap by a string.
PIECE_BYTES = 1 << 20

WHITE_SPACE = " \t\n\x0b\x0c\r"

_U = np.uint64
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def least_in_windows(keys: np.ndarray, width: int, n: int) -> np.ndarray:
    """The least of the ``width`` keys from each of the first ``n`` positions on."""
    # Of a window's part in one block of `width` and its part in the next.
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).reshape(-1)
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(since[:n], upto[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(text, anchor, low, high, gram hash, whole hash)``: starts low to high have this anchor.

    Positions are in ``data``; strings across texts are left out.
    """
    n = len(data) - length + 1
    per_text = np.maximum(0, np.diff(at) - length + 1)
    if not per_text.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    width = length - gram + 1
    begin = np.arange(len(data) - gram + 1)
    spans = Spans(data)
    hashes = spans.hashes(begin, begin + gram)
    keys = (hashes >> _U(32) << _U(32)) | begin.astype(np.uint64)
    anchors = (least_in_windows(keys, width, n) & _U(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    starts = np.arange(len(owner)) + (at[:-1] - np.cumsum(per_text) + per_text)[owner]
    anchors = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, low, high = anchors[first], starts[first], starts[last]
    return owner[first], a, low, high, hashes[a], spans.hashes(low, high + length)


def _pieces(texts: Texts, length: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: ``(pieces, text of each, offset of each)``."""
    if len(texts.data) <= 2 * PIECE_BYTES:
        yield texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for i in range(len(texts)):
        begin, end = int(texts.at[i]), int(texts.at[i + 1])
        for start in range(begin, max(begin + 1, end - length + 1), PIECE_BYTES):
            part = texts.data[start : min(end, start + PIECE_BYTES + length - 1)]
            yield Texts(part, np.array([0, len(part)])), np.array([i]), np.array([start - begin])


def text_key(text: bytes) -> tuple[int, int]:
    """120 bits of SHA-256, as Spark makes them in ``with_key``."""
    digest = hashlib.sha256(text).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def with_key(df: DataFrame, text: Column) -> DataFrame:
    sha = F.sha2(text, 256)
    parts = {f"k{i + 1}": F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)}
    return df.withColumns(parts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


# An anchor's run of starts as one number: the anchor, and how far before it the run begins and ends.
_ANCHOR, _FAR = "shiftright(run, 24)", "(shiftright(run, 12) & 4095)"
_LOW, _HIGH = f"({_ANCHOR} - {_FAR})", f"({_ANCHOR} - (run & 4095))"
_POSITION = f"xxhash64(k1, k2, {_ANCHOR})"


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(k1, k2, run, gram, whole)`` of every text with at least ``length`` bytes.

    ``gram`` names the bytes at the anchor, ``whole`` all strings of the run together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, texts in all_slices(batches):
            for pieces, owners, offsets in _pieces(texts, length):
                keys = [text_key(texts.text(int(i))) for i in owners]
                text, a, low, high, grams, whole = anchor_runs(pieces.data, pieces.at, length, gram)
                if len(owners) > 1:
                    # Of copies in one task, one is enough.
                    fresh = np.array([k not in seen and not seen.add(k) for k in keys])
                    own = fresh[text]
                    text, a, low, high, grams, whole = (x[own] for x in (text, a, low, high, grams, whole))
                at = a + (offsets - pieces.at[:-1])[text]
                both = np.array(keys, np.int64).reshape(-1, 2)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array((at << 24) | ((a - low) << 12) | (a - high))]
                    + [_signed(grams), _signed(whole)],
                    ["k1", "k2", "run", "gram", "whole"],
                )

    long_texts = docs.filter(F.octet_length("text") >= length).select("text")
    return long_texts.mapInArrow(run, "k1 long, k2 long, run long, gram long, whole long")


def repeated(rows: DataFrame, position: str, *name: str) -> DataFrame:
    """Names that belong to more than one position; copies of a text count as one.

    The shuffle carries two numbers for each name and task, however many positions have it.
    """
    p = F.expr(position)
    names = rows.groupBy(*name).agg(F.min(p).alias("_first"), F.max(p).alias("_last"))
    return names.filter("_first <> _last").select(*name)


def judged(steps: Steps, rows: DataFrame, position: str, shared: list[str], whole: list[str], *columns: str) -> DataFrame:
    """``(k1, k2, run, *columns, equal, open)``: all strings of the block repeat; it is to be ranked again.

    Blocks with equal whole pieces are equal. A block whose shared piece is its own alone
    has no string that repeats, and is left out. Blocks that share a piece stay open if
    one of them is not equal to another; of equal ones the first is enough for that.
    A whole piece that is 0 is none.

    What a join adds is written first, one row for each name: Spark then splits the rows of
    a frequent name over tasks. Those tables go as soon as the result is written.
    """
    p = F.expr(position)
    groups = rows.groupBy(*shared, *whole).agg(F.min(p).alias("_first"), F.max(p).alias("_last"))
    groups = groups.withColumn("equal", F.expr(f"_first <> _last AND {whole[0]} <> 0"))
    classes = groups.groupBy(*shared).agg(
        F.min("_first").alias("_low"), F.max("_last").alias("_high"), F.bool_or(~F.col("equal")).alias("_some")
    )
    classes = classes.filter("_some AND _low <> _high").select(*shared, F.lit(True).alias("_open"))
    groups, classes = steps.keep(groups, "groups"), steps.keep(classes, "classes")
    flags = groups.join(classes, shared, "left").filter("equal OR _open")
    flags = steps.keep(flags.select(*shared, *whole, "equal", "_open", "_first"), "flags")
    steps.drop(groups, classes)
    named = rows.join(flags, [*shared, *whole])
    still = F.coalesce("_open", F.lit(False)) & (~F.col("equal") | (p == F.col("_first")))
    verdicts = steps.keep(named.select("k1", "k2", "run", *columns, "equal", still.alias("open")), "verdicts")
    steps.drop(flags)
    return verdicts


def block_names(found: DataFrame, length: int, block: int) -> DataFrame:
    """``(k1, k2, run, i, s1, s2, w1, w2)`` for the blocks ``(run, i)`` of each text.

    Block i of an anchor holds the starts i to i + block - 1 bytes before it. Its shared
    piece lies in all strings of the block, its whole piece is all of them together; the
    whole is named only where all starts of the block belong to the run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                nodes = part.column("nodes").flatten()
                runs = nodes.field(0).to_numpy()
                i = nodes.field(1).to_numpy().astype(np.int64)
                a = runs >> 24
                low, high = a - ((runs >> 12) & 4095), a - (runs & 4095)
                data = np.frombuffer(part.column("text")[0].as_buffer(), np.uint8)
                one, two = Spans(data, 0), Spans(data, 1)
                inside = (a - i - block + 1 >= low) & (a - i <= high)
                start, end = a - i, a - i - block + 1 + length
                names = [one.hashes(start, end), two.hashes(start, end)]
                # Within the run the whole piece lies in the text; elsewhere it is not asked for.
                start, end = np.where(inside, a - i - block + 1, 0), np.where(inside, a - i + length, 0)
                names += [np.where(inside, x.hashes(start, end) | _U(1), _U(0)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), part.column(k)[0].as_py(), np.int64)) for k in ("k1", "k2")]
                    + [pa.array(runs), pa.array(i.astype(np.int32)), *map(_signed, names)],
                    ["k1", "k2", "run", "i", "s1", "s2", "w1", "w2"],
                )

    schema = "k1 long, k2 long, run long, i int, s1 long, s2 long, w1 long, w2 long"
    return found.select("k1", "k2", "text", "nodes").mapInArrow(run, schema)


def _blocks(first: str, last: str, block: int) -> Column:
    """Blocks with a start of the run, from ``first`` to ``last`` bytes before the anchor."""
    begin = f"cast(greatest(run & 4095, {first}) div {block} * {block} as int)"
    return F.explode(F.expr(f"sequence({begin}, greatest({begin}, cast(least({_FAR}, {last}) as int)), {block})"))


def _listed(nodes: DataFrame) -> DataFrame:
    """Blocks of each text as one array; a text has at most one for each of its positions."""
    return nodes.groupBy("k1", "k2").agg(F.collect_set(F.struct("run", "i")).alias("nodes"))


def repeated_starts(
    steps: Steps, docs: DataFrame, length: int = LENGTH, gram: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(ranges (k1, k2, first, last), texts (k1, k2, text))``: starts of strings that repeat.

    By distinct text; ``texts`` has those with a start whose anchor repeats.
    """
    gram = gram or max(1, min(GRAM, length // 2))
    found = steps.keep(anchors(docs, length, gram), "anchors")
    # The anchor's gram is the piece that all strings of a run share.
    names = steps.keep(repeated(found, _POSITION, "gram"), "grams")
    seeds = steps.keep(found.join(names, "gram", "left_semi"), "seeds")
    steps.drop(found, names)
    verdicts = judged(steps, seeds, _POSITION, ["gram"], ["whole"])
    steps.drop(seeds)
    runs = steps.keep(verdicts.distinct(), "runs")
    steps.drop(verdicts)

    text = F.col("text")
    texts = with_key(docs.filter(F.octet_length(text) >= length).select("text"), text)
    # Copies of a text are combined in each task before they are shuffled.
    single = texts.groupBy("k1", "k2").agg(F.first(text.cast("binary")).alias("text"))
    held = steps.keep(single.join(runs.select("k1", "k2").distinct(), ["k1", "k2"]), "texts")

    ranges = runs.filter("equal").selectExpr("k1", "k2", f"{_LOW} AS first", f"{_HIGH} AS last")
    # A block's shared piece must be most of a string for its rank to tell much.
    blocks = [b for b in BLOCKS if b == 1 or 4 * b <= length]
    nodes = runs.filter("open").withColumn("i", _blocks("0", str(length), blocks[0]))
    for level, block in enumerate(blocks):
        names = steps.keep(block_names(held.join(_listed(nodes), ["k1", "k2"]), length, block), "names")
        verdicts = judged(steps, names, f"xxhash64(k1, k2, {_ANCHOR}, i)", ["s1", "s2"], ["w1", "w2"], "i")
        steps.drop(names)
        equal = verdicts.filter("equal").selectExpr(
            "k1",
            "k2",
            f"greatest({_ANCHOR} - i - {block - 1}, {_LOW}) AS first",
            f"least({_ANCHOR} - i, {_HIGH}) AS last",
        )
        ranges = ranges.unionByName(equal)
        if block > 1:
            nodes = verdicts.filter("open").withColumn("i", _blocks("i", f"i + {block - 1}", blocks[level + 1]))
    return ranges, held


def word_anchor_runs(texts: Texts, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(text, anchor, low, high, gram hash)``: windows from word low to word high have this anchor.

    The anchor of a window of ``words`` words is the least hashed gram of ``gram`` words in it, with
    the white space between them, so that equal windows have equal anchors. Words are numbered
    within their text.
    """
    own = words_of(texts)
    n = max(0, len(own.start) - words + 1)
    owner = np.repeat(np.arange(len(texts)), own.counts)
    starts = np.flatnonzero(owner[:n] == owner[words - 1 :]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    begin = np.arange(len(own.start) - gram + 1)
    hashes = Spans(texts.data).hashes(own.start[begin], own.end[begin + gram - 1])
    keys = (hashes >> _U(32) << _U(32)) | begin.astype(np.uint64)
    anchors = (least_in_windows(keys, words - gram + 1, n) & _U(0xFFFFFFFF)).astype(np.int64)[starts]
    owner = owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, text = anchors[first], owner[first]
    base = own.first[text]
    return text, a - base, starts[first] - base, starts[last] - base, hashes[a]


def word_anchors(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """``(k1, k2, anchor, low, high, gram)`` of every text with at least ``words`` words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in all_slices(batches):
            text, *columns, grams = word_anchor_runs(texts, words, gram)
            used, at = np.unique(text, return_inverse=True)
            keys = np.array([text_key(texts.text(int(i))) for i in used], np.int64).reshape(-1, 2)[at]
            arrays = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(c.astype(np.int32)) for c in columns), _signed(grams)]
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "anchor", "low", "high", "gram"])

    long_texts = docs.filter(F.octet_length("text") >= 2 * words - 1).select("text")
    return long_texts.mapInArrow(run, "k1 long, k2 long, anchor int, low int, high int, gram long")


def repeated_windows(steps: Steps, docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """As ``repeated_starts``, but of strings from the start of one word to the end of the ``words``-th.

    Ranked twice: windows by their anchor, about two in ``words`` words, and those whose anchor
    repeats by all their bytes. ``last`` is where a string of ``2 * words - 1`` bytes, the least
    that so many words have, ends with the window.
    """
    gram, length = min(WORD_GRAM, words), 2 * words - 1
    found = steps.keep(word_anchors(docs, words, gram), "anchors")
    names = steps.keep(repeated(found, "xxhash64(k1, k2, anchor)", "gram"), "grams")
    runs = steps.keep(found.join(names, "gram", "left_semi").select("k1", "k2", "low", "high").distinct(), "runs")
    steps.drop(found, names)
    # A text has at most one run for each of its words.
    lists = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    text = F.col("text")
    keyed = with_key(docs.filter(F.octet_length(text) >= length).select("text"), text)
    single = keyed.groupBy("k1", "k2").agg(F.first(text.cast("binary")).alias("text"))
    texts = steps.keep(single.join(lists, ["k1", "k2"]), "texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[row].as_buffer(), np.uint8)
                own = words_of(Texts(data, np.array([0, len(data)])))
                low, high = (x.to_numpy() for x in batch.column("runs").slice(row, 1).flatten().flatten())
                sizes = high - low + 1
                windows = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                start, end = own.start[windows].astype(np.int64), own.end[windows + words - 1].astype(np.int64)
                keys = [pa.array(np.full(len(start), batch.column(k)[row].as_py(), np.int64)) for k in ("k1", "k2")]
                hashes = [_signed(Spans(data, i).hashes(start, end)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(start), pa.array(end - length), *hashes], ["k1", "k2", "first", "last", "s1", "s2"]
                )

    schema = "k1 long, k2 long, first long, last long, s1 long, s2 long"
    windows = steps.keep(texts.mapInArrow(run, schema), "windows")
    names = steps.keep(repeated(windows, "xxhash64(k1, k2, first)", "s1", "s2"), "repeats")
    return windows.join(names, ["s1", "s2"], "left_semi").select("k1", "k2", "first", "last"), texts.drop("runs")


def _with_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    lists = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    return texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "ranges")


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in the ranges."""
    runs: list[list[int]] = []
    for first, last in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    return [(a, b) for a, b in runs]


def cut_texts(ranges: DataFrame, texts: DataFrame, length: int, whole_characters: bool = False) -> DataFrame:
    """``(k1, k2, n_removed, n_spans, kept)`` of the distinct texts that lose bytes.

    With ``whole_characters`` a removed run is shortened to the characters that lie in it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                part = batch.column("ranges").slice(row, 1).flatten()
                runs = merged(list(zip(part.field(0).to_pylist(), part.field(1).to_pylist())), length)
                if whole_characters:
                    runs = [within_characters(text, a, b) for a, b in runs]
                bounds = [0, *[x for r in runs for x in r], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                rows.append((*(batch.column(k)[row].as_py() for k in ("k1", "k2")), len(text) - len(kept), len(runs), kept))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["k1", "k2", "n_removed", "n_spans", "kept"]
            )

    return _with_ranges(texts, ranges).mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def within_characters(text: bytes, first: int, end: int) -> tuple[int, int]:
    """The run without the bytes of characters that it cuts in two."""
    while first < end and text[first] & 0xC0 == 0x80:
        first += 1
    while end > first and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return first, end


def _at_least(words: int) -> str:
    """Pattern of texts with so many words; it looks at each character once."""
    white, black = r"[\x20\x09-\x0d]", r"[^\x20\x09-\x0d]"
    return rf"\A{white}*+(?:{black}++{white}++){{{words - 1}}}{black}"


def _copies(ids: DataFrame, length: int) -> DataFrame:
    """Keys of texts that more than one row has, where a string fits in."""
    return ids.filter(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")


def removal_report(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes)`` for every row.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in
    another row or the same, is removed; overlapping occurrences count, and all strings are
    judged on the input. A null or empty text has 0 bytes; shorter texts than ``length`` stay
    whole. Equal texts, also under one id, are copies of each other and are removed whole if
    they are long enough. ``n_passage_bytes`` tells, apart from that, how many bytes of the text lie
    in passages of ``words`` words or more, however few bytes those have, that occur twice.
    Other columns are not read; an empty table gives no rows.
    """
    # Runs of starts are held in 12 bits before and behind their anchor.
    if not 1 <= length <= 4096:
        raise ValueError("length must lie in 1 to 4096")
    steps = Steps(docs.sparkSession, "passages")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    ranges, texts = repeated_starts(steps, rows, length)
    cut = cut_texts(ranges, texts, length).select(
        "k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
    cut = steps.keep(cut, "cut")
    steps.leave(cut)
    others = Steps(docs.sparkSession, "windows")
    ranges, texts = repeated_windows(others, rows, words)
    covered = cut_texts(ranges, texts, 2 * words - 1).select("k1", "k2", F.col("n_removed").alias("n_passage_bytes"))
    covered = steps.keep(covered, "covered")
    others.leave()
    # From its first word to its last, a copy of enough words is one passage.
    passage = F.when(F.rlike("text", F.lit(_at_least(words))), F.octet_length(F.btrim("text", F.lit(WHITE_SPACE))))
    ids = with_key(rows, F.col("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "k1", "k2",
        F.coalesce(passage, F.lit(0)).cast("long").alias("passage"),
    )
    ids = steps.keep(ids, "ids")
    # Copies need no text: nothing of them stays. All others meet at most one cut text.
    copies = steps.keep(_copies(ids, 1).select("k1", "k2", F.lit(True).alias("copied")), "copies")
    changed = cut.join(covered, ["k1", "k2"], "full").join(copies, ["k1", "k2"], "full")
    changed = steps.keep(changed, "changed")
    steps.leave(ids, changed)
    joined = ids.join(changed, ["k1", "k2"], "left")
    copied = F.coalesce("copied", F.lit(False))
    whole = copied & (F.col("n_bytes") >= length)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied, F.col("passage")).otherwise(F.coalesce("n_passage_bytes", F.lit(0))).cast("long").alias("n_passage_bytes"),
    )


def without_repeats(
    docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = None
) -> DataFrame:
    """``docs``, all rows and columns, with repeated bytes cut from the texts.

    As ``removal_report``, but only whole characters are cut; ``n_chars``, if there is such a
    column, becomes the length of a text that was cut. With ``words``, the strings that are
    looked for have that many words and any number of bytes.
    """
    if words:
        length = 2 * words - 1
    steps = Steps(docs.sparkSession, "passages")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(text.alias("text"))
    ranges, texts = repeated_windows(steps, rows, words) if words else repeated_starts(steps, rows, length)
    cut = cut_texts(ranges, texts, length, whole_characters=True)
    cut = steps.keep(cut.select("k1", "k2", F.col("kept").cast("string").alias("kept")), "cut")
    steps.leave(cut)
    long_enough = rows.filter(F.rlike("text", F.lit(_at_least(words)))) if words else rows
    ids = steps.keep(with_key(long_enough, F.col("text")).select("k1", "k2", F.octet_length("text").alias("n_bytes")), "ids")
    copies = _copies(ids, length).select("k1", "k2")
    whole = copies.select("k1", "k2", F.lit("").alias("kept"))
    changed = steps.keep(whole.unionByName(cut.join(copies, ["k1", "k2"], "left_anti")), "changed")
    steps.leave(changed)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    joined = with_key(held, F.col("text")).join(changed, ["k1", "k2"], "left")
    columns = []
    for field in docs.schema:
        column = F.col("row").getField(field.name)
        if field.name == text_col:
            column = F.coalesce("kept", column)
        elif field.name == "n_chars":
            column = F.coalesce(F.char_length("kept").cast(field.dataType), column)
        columns.append(column.alias(field.name))
    return joined.select(*columns)
