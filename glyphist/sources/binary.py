"""Entity files with a binary payload, such as images."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from glyphist.functions.paths import base_name
from glyphist.operators.descriptors import extracted
from glyphist.sources.manifest import read_files


def read_entities(spark: SparkSession, path: str, glob: str | None = None, skip_hidden: bool = False) -> DataFrame:
    """``(id, path, content)`` of every file in the folder; equal base names share an id."""
    return read_files(spark, path, glob, skip_hidden).select(base_name("path").alias("id"), "path", "content")


def file_descriptors(
    spark: SparkSession, path: str, extract: Callable[[bytes], np.ndarray], dim: int, glob: str | None = None,
    skip_hidden: bool = False,
) -> DataFrame:
    """Descriptors of every file, by a decoder of the caller's choice."""
    return extracted(read_entities(spark, path, glob, skip_hidden).select("id", "content"), "id", "content", extract, dim)


def write_entities(rows: DataFrame, path: str, extension: str) -> None:
    """Each ``value`` and a line end as a file of its own in the new folder ``path``; NULL is empty text.

    The order of the names is that of the partitions and of the rows in them. In a folder of
    the machine, or one mounted there, the tasks write the files themselves: Hadoop's local
    file system would start two processes for each to set its permissions. A file is moved into
    place when it is whole, and a task that runs again writes the same names.
    """
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
        return
    folder = unquote(where.path) if where.scheme else path
    os.makedirs(folder)
    os.makedirs(f"{folder}.tmp", exist_ok=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        unfinished = os.path.join(f"{folder}.tmp", str(task.taskAttemptId()))
        for batch in batches:
            for value in batch.column("value").to_pylist():
                with open(unfinished, "wb") as file:
                    file.write(((value or "") + "\n").encode())
                os.replace(unfinished, os.path.join(folder, f"part-{task.partitionId():06d}-{n:09d}.{extension}"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select("value").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
