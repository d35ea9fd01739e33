"""Codebooks: training, restarts, seeded Lloyd steps, assignment, cost."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.functions.vectors import dense_vector, nearest, nearest_word
from glyphist.operators.blocks import Blocks, block_arrays, summed_partials, to_blocks
from glyphist.operators.restarts import DEFAULT_ITERATIONS, DEFAULT_SEED, DEFAULT_WORDS, Trained, train_run
from glyphist.schema import MODEL_MAX_BYTES, Codebook
from glyphist.session import release, stored


def train_codebook(
    descriptors: DataFrame,
    k: int = DEFAULT_WORDS,
    iterations: int = DEFAULT_ITERATIONS,
    init_mode: str = "k-means||",
    seed: int = DEFAULT_SEED,
) -> KMeansModel:
    """k-means over all descriptors, as a Spark ML model; ``operators.restarts`` has several runs.

    The steps read packed blocks in the shared folder. Spark ML's own fit keeps every vector as a
    few objects in the executors' memory, and a step over 18 million of 4 numbers took it 1.7 times as long.
    The result may have fewer than ``k`` words if there are fewer distinct vectors.
    """
    run = train_run(descriptors, k, iterations, init_mode, seed)
    vectors = descriptors.select(dense_vector("features").alias("features"))
    return _spark_model(run, vectors, KMeans(k=k, maxIter=iterations, initMode=init_mode, seed=seed))


def _spark_model(run: Trained, vectors: DataFrame, settings: KMeans) -> KMeansModel:
    """Spark ML's model of the centres of ``run``, with the settings and the summary of a fit over ``vectors``.

    A fit of no steps that starts from as many random rows as there are returns just these rows.
    """
    spark = vectors.sparkSession
    rows = spark.createDataFrame([(Vectors.dense(c),) for c in run.centres], ["features"])
    alone = {settings.k: max(len(run.centres), 2), settings.maxIter: 0, settings.initMode: "random"}
    model = settings.fit(rows, alone)
    model = model.copy({p: settings.getOrDefault(p) for p in alone})
    summary = spark._jvm.org.apache.spark.ml.clustering.KMeansSummary(
        model.transform(vectors)._jdf,
        model.getPredictionCol(),
        model.getFeaturesCol(),
        model.getK(),
        run.steps,
        run.cost,
    )
    model._java_obj.setSummary(spark._jvm.scala.Some(summary))
    return model


def codebook_of(model: KMeansModel) -> Codebook:
    return Codebook(model.clusterCenters())


def first_descriptors(descriptors: DataFrame, k: int, *order: Column | str) -> Codebook:
    """Initial centres: the ``k`` descriptors that come first in a total order."""
    return Codebook.from_df(
        descriptors.orderBy(*order).limit(k).select(
            F.monotonically_increasing_id().alias("word"), F.col("features").alias("centroid")
        )
    )


def assign_words(descriptors: DataFrame, codebook: Codebook) -> DataFrame:
    """Add the nearest ``word`` (ties: lowest) and its squared distance ``dist``.

    A narrow projection: no shuffle, no key needed.
    """
    match = nearest_word(codebook.centroids)(F.col("features"))
    return descriptors.withColumn("_match", match).select(
        *[c for c in descriptors.columns if c != "features"],
        F.col("_match.word").alias("word"),
        F.col("_match.dist").alias("dist"),
    )


def assign_words_of_table(
    descriptors: DataFrame, codebook: DataFrame, max_bytes: int = MODEL_MAX_BYTES
) -> DataFrame:
    """``assign_words`` for a codebook table ``(word, centroid)`` of any size.

    The words are taken in blocks of at most ``max_bytes``, in the order of their numbers. Each
    block is one narrow pass that keeps the best word so far, so that a task holds one
    block at a time; between two passes their result is written, and removed after the next.
    """
    low, high, dim = codebook.agg(F.min("word"), F.max("word"), F.max(F.size("centroid"))).first()
    if low is None:
        raise ValueError("codebook table is empty")
    per_block = max(1, max_bytes // (8 * dim))
    current = descriptors.withColumn("_best", F.lit(None).cast("struct<word: int, dist: double>"))
    written = None
    for first in range(low, high + 1, per_block):
        rows = codebook.filter(F.col("word").between(first, first + per_block - 1)).orderBy("word").collect()
        if not rows:
            continue
        if written is not None or first > low:
            following = stored(current, "assignment")
            if written is not None:
                release(written)
            current = written = following
        match = nearest_word(Codebook([r.centroid for r in rows]).centroids, [r.word for r in rows])(F.col("features"))
        nearer = F.col("_best").isNull() | (F.col("_match.dist") < F.col("_best.dist"))
        found = current.withColumn("_match", match)
        current = found.withColumn("_best", F.when(nearer, F.col("_match")).otherwise(F.col("_best"))).drop("_match")
    others = [c for c in descriptors.columns if c != "features"]
    return current.select(*others, F.col("_best.word").alias("word"), F.col("_best.dist").alias("dist"))


def codebook_cost(assignment: DataFrame) -> DataFrame:
    """Within-set sum of squared distances and the number of descriptors."""
    return assignment.agg(F.sum("dist").alias("wssse"), F.count("*").alias("n_descriptors"))


def lloyd_step(blocks: Blocks, codebook: Codebook) -> tuple[Codebook, float]:
    """One Lloyd step over ``to_blocks`` rows: new centres, and the cost under the old ones.

    Each task adds up its vectors per word. A word without descriptors keeps its centre.
    """
    centroids = codebook.centroids
    k, dim = centroids.shape

    def word_sums(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        # Per word: the vector sum, then the count, then the cost.
        totals = np.zeros((k, dim + 2))
        for batch in batches:
            for _, points in block_arrays(batch, dim):
                words, dist = nearest(points, centroids)
                for j in range(dim):
                    totals[:, j] += np.bincount(words, weights=points[:, j], minlength=k)
                totals[:, dim] += np.bincount(words, minlength=k)
                totals[:, dim + 1] += np.bincount(words, weights=dist, minlength=k)
        return totals

    totals = summed_partials(blocks, word_sums, k, dim + 2)
    counts = totals[:, dim]
    moved = np.where(counts[:, None] > 0, totals[:, :dim] / np.maximum(counts, 1)[:, None], centroids)
    return Codebook(moved), float(totals[:, dim + 1].sum())


def lloyd(descriptors: DataFrame, initial: Codebook, steps: int) -> tuple[Codebook, list[float]]:
    """``steps`` Lloyd steps from given centres, and the cost before each of them.

    Only the k centres pass from step to step, so the lineage does not grow.
    """
    blocks = to_blocks(descriptors, initial.dim)
    codebook, costs = initial, []
    try:
        for _ in range(steps):
            codebook, cost = lloyd_step(blocks, codebook)
            costs.append(cost)
    finally:
        blocks.release()
    return codebook, costs
