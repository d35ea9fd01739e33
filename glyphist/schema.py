"""Row shapes that the operators exchange, and the codebook and classifier models.

Descriptors, assignments, histograms and training rows are DataFrames of any size. A
codebook (k words x d numbers) and a classifier (C classes x k weights) are parameters
of the run, not data: their size is set by k, d and C, checked here, and they travel to
the tasks inside the function that uses them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODEBOOK_SCHEMA = T.StructType(
    [
        T.StructField("word", T.IntegerType(), False),
        T.StructField("centroid", T.ArrayType(T.DoubleType(), False), False),
    ]
)
CLASSIFIER_SCHEMA = T.StructType(
    [
        T.StructField("class", T.DoubleType(), False),
        T.StructField("weights", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("threshold", T.DoubleType(), False),
    ]
)
RUN_METRICS_SCHEMA = T.StructType(
    [
        T.StructField("stage", T.StringType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

# What a model may take in the driver and in every task, unless a reader is given another
# limit. A codebook beyond it stays a table, see ``assign_words_of_table``.
MODEL_MAX_BYTES = 512 * 1024 * 1024


def _matrix(rows, what: str) -> np.ndarray:
    matrix = np.ascontiguousarray(rows, dtype=np.float64)
    if matrix.ndim != 2 or 0 in matrix.shape:
        raise ValueError(f"{what} must be a non-empty table of equally long vectors")
    return matrix


def _collect_checked(df: DataFrame, vector: str, what: str, max_bytes: int) -> list:
    """Collect a model table after checking its size inside Spark."""
    rows, numbers = df.agg(F.count("*"), F.sum(F.size(vector))).first()
    if not rows:
        raise ValueError(f"{what} table is empty")
    if numbers * 8 > max_bytes:
        raise ValueError(f"{what} takes {numbers * 8} bytes, limit {max_bytes}")
    return df.collect()


@dataclass(frozen=True)
class Codebook:
    """k centroids of equal dimension; row ``i`` is word ``i``."""

    centroids: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "centroids", _matrix(self.centroids, "codebook"))

    @property
    def size(self) -> int:
        return self.centroids.shape[0]

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, CODEBOOK_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame, max_bytes: int = MODEL_MAX_BYTES) -> Codebook:
        rows = _collect_checked(df, "centroid", "codebook", max_bytes)
        return cls([r["centroid"] for r in sorted(rows, key=lambda r: r["word"])])


@dataclass(frozen=True)
class LinearModel:
    """One weight vector and one decision threshold per class."""

    classes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray = field(default=None)

    def __post_init__(self):
        classes = np.asarray(self.classes, dtype=np.float64)
        weights = _matrix(self.weights, "classifier")
        given = 0.0 if self.thresholds is None else self.thresholds
        thresholds = np.broadcast_to(np.asarray(given, dtype=np.float64), classes.shape).copy()
        if classes.shape != (weights.shape[0],):
            raise ValueError("one weight vector per class is required")
        object.__setattr__(self, "classes", classes)
        object.__setattr__(self, "weights", weights)
        object.__setattr__(self, "thresholds", thresholds)

    @property
    def dim(self) -> int:
        return self.weights.shape[1]

    def with_threshold(self, threshold: float) -> LinearModel:
        """The same weights with one threshold for every class."""
        return LinearModel(self.classes, self.weights, threshold)

    def with_thresholds(self, by_class: dict[float, float]) -> LinearModel:
        """Thresholds of single classes; the others keep theirs."""
        merged = [by_class.get(c, t) for c, t in zip(self.classes.tolist(), self.thresholds)]
        return LinearModel(self.classes, self.weights, merged)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (float(c), w.tolist(), float(t))
            for c, w, t in zip(self.classes, self.weights, self.thresholds)
        ]
        return spark.createDataFrame(rows, CLASSIFIER_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame, max_bytes: int = MODEL_MAX_BYTES) -> LinearModel:
        rows = sorted(_collect_checked(df, "weights", "classifier", max_bytes), key=lambda r: r["class"])
        return cls(
            [r["class"] for r in rows],
            [r["weights"] for r in rows],
            [r["threshold"] for r in rows],
        )


def dimension_report(descriptors: DataFrame) -> DataFrame:
    """Smallest and largest vector length, and rows without a vector."""
    return descriptors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("features").isNull()).alias("n_null"),
        F.min(F.size("features")).alias("min_dim"),
        F.max(F.size("features")).alias("max_dim"),
    )


def require_uniform_dimension(descriptors: DataFrame) -> int:
    """The common vector length; raises if vectors are missing or of unequal length."""
    row = dimension_report(descriptors).first()
    if row.n_rows == 0:
        raise ValueError("no descriptors")
    if row.n_null or row.min_dim != row.max_dim:
        raise ValueError(f"descriptor dimensions differ: {row.asDict()}")
    return row.min_dim
