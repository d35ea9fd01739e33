"""Row blocks for jobs that read the same vectors many times, and sums over them.

A block is some thousand rows as packed numbers: all values of dense rows, or the words and
values of sparse ones. Reading it back in a task is a memory copy, where an array column is
converted value by value in every step. Numbers of sparse rows take as few bytes as hold them
exactly, since a step of many is mostly the reading of its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphist.functions.vectors import SparseRows, feature_rows
from glyphist.session import release, stored

BLOCK_BYTES = 1 << 20
# What the tasks of a step may send to the driver together; more is added up in tasks first.
STEP_BYTES = 64 << 20

_DENSE = {"labels": "binary", "points": "binary"}
_SPARSE = {"labels": "binary", "sizes": "binary", "words": "binary", "freqs": "binary", "short": "boolean"}
# Sparse blocks from so many entries on are written in short form; a smaller one is read in no time.
SHORT_ENTRIES = 1_024


@dataclass(frozen=True)
class Blocks:
    """A written table of row blocks, and the number of tasks that read it."""

    table: DataFrame
    tasks: int

    def release(self) -> None:
        release(self.table)


def is_sparse(rows: DataFrame) -> bool:
    return isinstance(rows.schema["features"].dataType, T.StructType)


def to_blocks(rows: DataFrame, dim: int, label: str | None = None) -> Blocks:
    """Rows with dense or sparse ``features``, written once to the shared folder.

    Every step reads them from there, so a lost executor costs no more than its tasks;
    ``release`` them after the last step. The bytes of sparse rows follow their words,
    whatever ``dim`` is.
    """
    source = rows.select((F.col(label) if label else F.lit(0.0)).cast("double").alias("label"), "features")
    fields = _SPARSE if is_sparse(rows) else _DENSE

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = feature_rows(batch.column("features"), dim)
            labels = np.ascontiguousarray(batch.column("label").to_numpy(zero_copy_only=False))
            for part in _runs(points):
                arrays = [pa.array([c]) for c in _packed_block(labels[part], points[part])]
                yield pa.RecordBatch.from_arrays(arrays, list(fields))

    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    table = stored(source.mapInArrow(pack, schema), "blocks")
    return Blocks(table, table.rdd.getNumPartitions())


def _runs(points: np.ndarray | SparseRows) -> Iterator[slice]:
    """Runs of rows of about ``BLOCK_BYTES`` each, at least a row."""
    if isinstance(points, SparseRows):
        ends = 12 * points.at[1:] + 12 * np.arange(1, len(points) + 1)
    else:
        ends = 8 * points.shape[1] * np.arange(1, len(points) + 1)
    first = 0
    while first < len(points):
        limit = (ends[first - 1] if first else 0) + BLOCK_BYTES
        last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
        yield slice(first, last)
        first = last


def _packed_block(labels: np.ndarray, points: np.ndarray | SparseRows) -> list[bytes | bool]:
    if not isinstance(points, SparseRows):
        return [np.ascontiguousarray(c).tobytes() for c in (labels, points)]
    sizes = np.diff(points.at)
    if len(points.words) < SHORT_ENTRIES:
        columns = labels, sizes.astype(np.int32), points.words.astype(np.int32), points.values
        return [*[np.ascontiguousarray(c).tobytes() for c in columns], False]
    return [_packed_floats(labels), _packed_counts(sizes), _packed_counts(points.words), _packed_floats(points.values), True]


def _packed_counts(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the smallest type that holds them, after its size."""
    small = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    return np.int64(small.itemsize).tobytes() + small.tobytes()


def _counts(packed: pa.Buffer) -> np.ndarray:
    size = int(np.frombuffer(packed, np.int64, 1)[0])
    return np.frombuffer(packed, f"u{size}", offset=8).astype(np.int64)


def _packed_floats(numbers: np.ndarray) -> bytes:
    """The distinct numbers, by their bits, and the place of each among them; as they are if many differ."""
    numbers = np.ascontiguousarray(numbers)
    distinct, places = np.unique(numbers.view(np.int64), return_inverse=True)
    if len(distinct) > min(65_536, max(1, len(numbers) // 2)):
        return np.int64(0).tobytes() + numbers.tobytes()
    small = places.astype(np.min_scalar_type(max(0, len(distinct) - 1)))
    return np.int64(len(distinct)).tobytes() + distinct.tobytes() + small.tobytes()


def _floats(packed: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    if n == 0:
        return np.frombuffer(packed, offset=8)
    return np.frombuffer(packed, np.float64, n, 8)[np.frombuffer(packed, np.min_scalar_type(n - 1), offset=8 + 8 * n)]


def block_arrays(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray | SparseRows]]:
    """(labels, rows) of every block in a batch."""
    dense = batch.schema.names == list(_DENSE)
    for row in range(batch.num_rows):
        buffers = [column[row].as_buffer() for column in batch.columns[: 2 if dense else 4]]
        if dense:
            yield np.frombuffer(buffers[0]), np.frombuffer(buffers[1]).reshape(-1, dim)
            continue
        if batch.column("short")[row].as_py():
            labels, values = _floats(buffers[0]), _floats(buffers[3])
            sizes, words = _counts(buffers[1]), _counts(buffers[2])
        else:
            labels, values = np.frombuffer(buffers[0]), np.frombuffer(buffers[3])
            sizes, words = np.frombuffer(buffers[1], np.int32), np.frombuffer(buffers[2], np.int32)
        yield labels, SparseRows(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), words, values)


_PART = "part int, key int, vector binary"


def summed_partials(
    blocks: Blocks,
    per_task: Callable[[Iterable[pa.RecordBatch]], np.ndarray],
    n_keys: int,
    width: int,
    step_bytes: int = STEP_BYTES,
) -> np.ndarray:
    """Add up ``per_task(batches) -> matrix`` over all tasks.

    The tasks are those of the written table, so their number follows its bytes and not the
    cores that the session happens to have. If all their matrices fit in ``step_bytes``, the
    driver adds them, in the order of the tasks. Otherwise groups of about the square root
    of the tasks are added up in tasks first, and if those are still too many, each key alone:
    no task reads all matrices unless it reads one key of the groups' sums.
    """
    matrix = n_keys * width * 8
    groups = math.isqrt(blocks.tasks - 1) + 1 if blocks.tasks else 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = per_task(batches)
        part = TaskContext.get().partitionId() % groups
        yield from _packed(part, np.flatnonzero(totals.any(axis=1)), totals)

    parts = blocks.table.mapInArrow(run, _PART)
    if blocks.tasks * matrix > step_bytes:
        parts = _added(parts, min(blocks.tasks, groups * n_keys), "part", "key")
        if groups * matrix > step_bytes:
            parts = _added(parts, min(n_keys, blocks.tasks), "key")
    result = np.zeros((n_keys, width))
    sums = parts.toArrow()
    for key, vector in zip(sums["key"].to_pylist(), sums["vector"]):
        result[key] += np.frombuffer(vector.as_buffer())
    return result


def _added(parts: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Sums of the vectors with equal ``by``; a task holds one vector for each of its keys."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            part = batch.column("part").to_pylist() if "part" in by else [0] * batch.num_rows
            for name, vector in zip(zip(part, batch.column("key").to_pylist()), batch.column("vector")):
                own = np.frombuffer(vector.as_buffer())
                totals[name] = totals[name] + own if name in totals else own
        for part, key in sorted(totals):
            yield from _packed(part, np.array([key]), {key: totals[part, key]})

    return parts.repartition(max(1, tasks), *by).mapInArrow(add, _PART)


def _packed(part: int, keys: np.ndarray, rows) -> Iterator[pa.RecordBatch]:
    if len(keys):
        vectors = [np.ascontiguousarray(rows[k]).tobytes() for k in keys.tolist()]
        parts = pa.array(np.full(len(keys), part, np.int32))
        yield pa.RecordBatch.from_arrays([parts, pa.array(keys.astype(np.int32)), pa.array(vectors)], ["part", "key", "vector"])
