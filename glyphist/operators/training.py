"""Training rows: labels joined with histograms, and the one-vs-rest relabelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.operators.joins import HOT_KEY_ROWS, HOT_KEY_SHARE, join_on_entity


def training_rows(
    labelled: DataFrame, histograms: DataFrame, min_rows: int = HOT_KEY_ROWS, share: float = HOT_KEY_SHARE
) -> DataFrame:
    """``(id, label, features)`` of entities that have both; repeated labels repeat the row."""
    known = labelled.filter(F.col("label").isNotNull()).select("id", "label")
    return join_on_entity(known, histograms, "id", min_rows, share).select("id", "label", "features")


def class_target(label: Column | str, class_label: Column | float) -> Column:
    """1.0 for rows of the class, 0.0 for all others."""
    column = F.col(label) if isinstance(label, str) else label
    return F.when(column == class_label, F.lit(1.0)).otherwise(F.lit(0.0))


def class_rows(rows: DataFrame, class_label: float) -> DataFrame:
    """Binary training rows of one class."""
    return rows.withColumn("y", class_target("label", F.lit(class_label)))


def one_vs_rest(rows: DataFrame, classes: Sequence[float]) -> DataFrame:
    """Binary training rows of all given classes, with the class as a column."""
    every = rows.withColumn("class", F.explode(F.array(*[F.lit(float(c)) for c in classes])))
    return every.withColumn("y", class_target("label", F.col("class")))
