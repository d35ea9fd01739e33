"""Entities to local descriptors: ``(id, pos, features ARRAY<DOUBLE>)``.

Each generator emits 0..N vectors of one length per entity. Entities without
descriptors emit no row. ``pos`` need not be unique within an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.functions.vectors import to_double

OUTPUT_ROWS = 8_192


def sub_vectors(df: DataFrame, id_col: str, vector: str, parts: int, width: int) -> DataFrame:
    """Cut one long vector into ``parts`` consecutive vectors of ``width`` values."""
    whole = to_double(vector)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(whole, i * width + 1, width)
    )
    return df.select(F.col(id_col).alias("id"), F.posexplode(pieces).alias("pos", "features"))


def row_descriptors(df: DataFrame, id_col: str, pos: Column | str, values: Sequence[Column]) -> DataFrame:
    """One descriptor per row, from numeric columns; entities may span many rows."""
    place = F.col(pos) if isinstance(pos, str) else pos
    return df.select(
        F.col(id_col).alias("id"), place.alias("pos"), F.array(*[v.cast("double") for v in values]).alias("features")
    )


def line_item_descriptors(lineitem: DataFrame) -> DataFrame:
    """Line items of an order, scaled to about [0, 1]."""
    return row_descriptors(
        lineitem,
        "l_orderkey",
        "l_linenumber",
        [
            F.col("l_quantity") / 50,
            F.col("l_discount") * 10,
            F.col("l_tax") * 12.5,
            F.col("l_extendedprice") / 105000,
        ],
    )


# Character classes counted in a line, in output order. A sixth number
# counts the remaining characters.
LINE_CHARACTER_CLASSES = ("[aeiou]", "[bcdfghjklmnpqrstvwxyz]", "[A-Z]", "[0-9]", "[ ]")


def line_descriptors(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a document as counts of character classes."""
    lines = documents.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    counts = [F.regexp_count("line", F.lit(c)) for c in LINE_CHARACTER_CLASSES]
    rest = F.length("line") - sum(counts[1:], counts[0])
    return row_descriptors(lines, "id", "pos", [*counts, rest])


def event_descriptors(events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """A user's events as (value, hour of day, one-hot event type)."""
    one_hot = [F.when(F.col("event_type") == t, 1.0).otherwise(0.0) for t in event_types]
    return row_descriptors(events, "user_id", "event_id", [F.col("value"), F.hour("ts"), *one_hot])


def extracted(
    entities: DataFrame, id_col: str, payload: str, extract: Callable[[object], np.ndarray], dim: int
) -> DataFrame:
    """Descriptors from a user function ``payload value -> (n, dim) array``.

    For payloads that only a library can read, such as image bytes. The function runs in
    the tasks, one entity at a time; its rows leave in bounded Arrow batches.
    """
    id_type = entities.schema[id_col].dataType.simpleString()
    source = entities.select(F.col(id_col).alias("id"), F.col(payload).alias("payload"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("id"), batch.column("payload")):
                found = np.asarray(extract(value.as_py()), dtype=np.float64)
                if found.size and (found.ndim != 2 or found.shape[1] != dim):
                    raise ValueError(f"expected (n, {dim}) descriptors, found {found.shape}")
                for start in range(0, len(found), OUTPUT_ROWS):
                    part = np.ascontiguousarray(found[start : start + OUTPUT_ROWS])
                    places = np.arange(start, start + len(part), dtype=np.int32)
                    offsets = np.arange(0, part.size + 1, dim, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(key, len(part)),
                            pa.array(places),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel())),
                        ],
                        ["id", "pos", "features"],
                    )

    return source.mapInArrow(run, f"id {id_type}, pos int, features array<double>")
