"""LIBSVM output of ``(label, features)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.functions.text import libsvm_line
from glyphist.functions.vectors import dense_vector


def libsvm_lines(rows: DataFrame, digits: int = 5) -> DataFrame:
    """``(value)``: one dense LIBSVM line per row, values with fixed decimals."""
    return rows.select(libsvm_line(F.col("label"), F.col("features"), digits).alias("value"))


def write_libsvm_lines(rows: DataFrame, path: str, digits: int = 5) -> None:
    """Lines with fixed decimals, written by the tasks."""
    libsvm_lines(rows, digits).write.mode("overwrite").text(path)


def write_libsvm(rows: DataFrame, path: str) -> None:
    """Spark's own LIBSVM format, full precision."""
    vectors = rows.select(F.col("label").cast("double").alias("label"), dense_vector("features").alias("features"))
    vectors.write.format("libsvm").mode("overwrite").save(path)
