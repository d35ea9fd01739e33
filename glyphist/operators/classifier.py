"""Linear one-vs-rest classifiers: training, thresholds, prediction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.functions.vectors import (
    BLOCK_CELLS,
    SparseRows,
    class_margins,
    dense_vector,
    feature_rows,
    margins,
    top_classes,
)
from glyphist.operators.blocks import Blocks, block_arrays, is_sparse, summed_partials, to_blocks
from glyphist.operators.histogram import dense_features
from glyphist.operators.training import class_target
from glyphist.schema import LinearModel

DEFAULT_ITERATIONS = 200
CLASSES_PER_JOB = 256
# Numbers that a task of a linear SVM's step reads at least: with fewer, starting the task takes longer.
FIT_TASK_BYTES = 32 << 20

# The thresholds given for a classifier over all categories, and for
# single food categories.
DEFAULT_THRESHOLD = -0.4013
CATEGORY_THRESHOLDS = {
    "beer": -0.136,
    "salad": -0.132,
    "paella": -0.1345,
    "cake": -0.134,
    "steak": -0.1362,
    "coffee": -0.132,
    "hamburger": -0.13599,
    "icecream": -0.1367,
    "pasta": -0.1353,
    "eggs": -0.137,
    "potatoes": -0.1372,
    "pizza": -0.12805,
    "sushi": -0.1305,
    "wine": -0.1375,
}


def _gradient_sums(blocks: Blocks, classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hinge subgradient sums of all classes, and the row count, in one pass."""
    n_classes, dim = weights.shape

    def gradients(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        totals = np.zeros((n_classes, dim + 1))
        for batch in batches:
            for labels, points in block_arrays(batch, dim):
                # The relabelling of every class is a mask over the same rows.
                side = np.where(labels[:, None] == classes, 1.0, -1.0)
                if isinstance(points, SparseRows):
                    active = side * points.margins(weights) < 1.0
                    totals[:, :dim] -= points.signed_sums(active * side, dim)
                else:
                    active = side * (points @ weights.T) < 1.0
                    totals[:, :dim] -= (active * side).T @ points
                totals[:, dim] += len(points)
        return totals

    return summed_partials(blocks, gradients, n_classes, dim + 1)


def _descend(blocks, classes, dim, iterations, step, reg, tolerance) -> np.ndarray:
    weights = np.zeros((len(classes), dim))
    running = np.ones(len(classes), dtype=bool)
    for t in range(1, iterations + 1):
        sums = _gradient_sums(blocks, classes[running], weights[running])
        rate = step / np.sqrt(t)
        old = weights[running]
        new = old * (1.0 - rate * reg) - rate * sums[:, :dim] / sums[:, dim:]
        weights[running] = new
        if t > 1:
            change = np.linalg.norm(new - old, axis=1)
            done = change < tolerance * np.maximum(np.linalg.norm(new, axis=1), 1.0)
            running[np.flatnonzero(running)[done]] = False
        if not running.any():
            break
    return weights


def train_hinge_descent(
    rows: DataFrame,
    classes: Sequence[float],
    dim: int,
    iterations: int = DEFAULT_ITERATIONS,
    step: float = 1.0,
    reg: float = 0.01,
    tolerance: float = 0.001,
) -> LinearModel:
    """Full-batch subgradient descent on the hinge loss, one model per class.

    Same updates as MLlib's SGD classifier with all rows in every step and no intercept,
    but one pass over ``rows (label, features)``, dense or sparse, serves up to
    CLASSES_PER_JOB classes.
    """
    labels = np.asarray(classes, dtype=np.float64)
    blocks = to_blocks(rows, dim, "label")
    try:
        weights = [
            _descend(blocks, labels[i : i + CLASSES_PER_JOB], dim, iterations, step, reg, tolerance)
            for i in range(0, len(labels), CLASSES_PER_JOB)
        ]
    finally:
        blocks.release()
    return LinearModel(labels, np.vstack(weights))


def train_linear_svc(
    rows: DataFrame,
    n_classes: int,
    iterations: int = DEFAULT_ITERATIONS,
    reg: float = 0.01,
    parallelism: int = 4,
    dim: int | None = None,
) -> LinearModel:
    """Spark ML's linear SVM in a one-vs-rest loop; labels are 0.0 .. n_classes - 1.

    Sparse rows become dense vectors of ``dim`` numbers, as the fit asks for. A step of a class is a
    job of its own, so the number of its tasks follows the bytes and not the cores; classes
    are fitted beside each other.
    """
    if is_sparse(rows):
        if dim is None:
            raise ValueError("sparse rows need their dimension")
        tasks = _fit_tasks(rows.count(), dim)
        rows = rows.withColumn("features", dense_features("features", dim)).coalesce(tasks)
    else:
        n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
        rows = rows.coalesce(_fit_tasks(n, width or 0))
    svc = LinearSVC(maxIter=iterations, regParam=reg, fitIntercept=False, standardization=False)
    data = rows.select(F.col("label").cast("double").alias("label"), dense_vector("features").alias("features"))
    fitted = OneVsRest(classifier=svc, parallelism=parallelism).fit(data)
    if len(fitted.models) != n_classes:
        raise ValueError(f"labels give {len(fitted.models)} classes, expected {n_classes}")
    return LinearModel(
        np.arange(n_classes, dtype=np.float64), np.vstack([m.coefficients.toArray() for m in fitted.models])
    )


def _fit_tasks(n: int, dim: int) -> int:
    return max(1, -(-8 * n * dim // FIT_TASK_BYTES))


def top_scores(rows: DataFrame, model: LinearModel, top: int) -> DataFrame:
    """``(id, label, rank, class, margin, predicted)``: the ``top`` classes of each row by margin.

    At most ``top`` rows per row, however many classes there are. Ranks begin at 1; equal
    margins go to the class that the model has first.
    """
    if top < 1:
        raise ValueError("top must be at least 1")
    best = top_classes(model.weights, model.classes, model.thresholds, top, CLASSES_PER_JOB)(F.col("features"))
    long = rows.withColumn("_best", best).select("id", "label", F.posexplode("_best").alias("_rank", "_entry"))
    return long.select("id", "label", (F.col("_rank") + 1).alias("rank"), "_entry.class", "_entry.margin", "_entry.predicted")


def score_rows(rows: DataFrame, model: LinearModel) -> DataFrame:
    """``(id, class, margin, predicted, actual)`` for every row and class.

    ``predicted`` is 1.0 where the margin exceeds the threshold of the class. Beyond
    CLASSES_PER_JOB classes the rows are read once per block of classes, which bounds
    the size of an Arrow batch.
    """
    n = len(model.classes)
    blocks = [_score_block(rows, model, slice(i, i + CLASSES_PER_JOB)) for i in range(0, n, CLASSES_PER_JOB)]
    return reduce(DataFrame.unionByName, blocks)


def _score_block(rows: DataFrame, model: LinearModel, block: slice) -> DataFrame:
    names = F.array(*[F.lit(c) for c in model.classes[block].tolist()])
    limits = F.array(*[F.lit(t) for t in model.thresholds[block].tolist()])
    scored = rows.withColumn("_margins", class_margins(model.weights[block])(F.col("features")))
    long = scored.select("id", "label", F.posexplode("_margins").alias("_c", "margin"))
    return long.select(
        "id",
        F.get(names, F.col("_c")).alias("class"),
        "margin",
        F.when(F.col("margin") > F.get(limits, F.col("_c")), 1.0).otherwise(0.0).alias("predicted"),
        class_target("label", F.get(names, F.col("_c"))).alias("actual"),
    )


def confusion_of(rows: DataFrame, model: LinearModel) -> DataFrame:
    """``(class, tp, tn, fp, fn)`` of ``rows (label, features)``, as ``confusion`` of ``score_rows``.

    Counted batch by batch: a task sends four numbers per class, not a row per row and class.
    """
    classes, limits, weights = model.classes, model.thresholds, model.weights
    block = max(1, BLOCK_CELLS // len(classes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((4, len(classes)), np.int64), False
        for batch in batches:
            points = feature_rows(batch.column("features"), model.dim)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for start in range(0, len(points), block):
                hit = margins(points[start : start + block], weights) > limits
                real = labels[start : start + block, None] == classes
                pairs = (hit & real, ~hit & ~real, hit & ~real, ~hit & real)
                totals += np.array([p.sum(axis=0) for p in pairs])
                seen = True
        if seen:
            names = ["class", "tp", "tn", "fp", "fn"]
            yield pa.RecordBatch.from_arrays([pa.array(classes), *map(pa.array, totals)], names)

    parts = rows.select(F.col("label").cast("double").alias("label"), "features").mapInArrow(
        run, "class double, tp long, tn long, fp long, fn long"
    )
    return parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
