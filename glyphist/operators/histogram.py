"""Word counts and L1-normalised histograms per entity.

Counting by (id, word) combines inside the map tasks, and an entity that owns a third of
all descriptors is spread over its k words. What follows by id has at most k rows per
entity, whatever the number of descriptors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_counts(assignment: DataFrame) -> DataFrame:
    """``(id, word, n)``."""
    return assignment.groupBy("id", "word").agg(F.count("*").alias("n"))


def histogram_long(counts: DataFrame) -> DataFrame:
    """``(id, word, n, freq)``, words that occur only."""
    total = F.sum("n").over(Window.partitionBy("id"))
    return counts.select("id", "word", "n", (F.col("n") / total).alias("freq"))


def histogram_sparse(counts: DataFrame) -> DataFrame:
    """``(id, features STRUCT<words, freqs>)``: the words that occur, ascending, and their frequencies.

    The form in which histograms are stored, joined and trained on: its size follows the
    words of an entity and not the codebook.
    """
    entries = F.sort_array(F.collect_list(F.struct("word", "n"))).alias("_entries")
    per_entity = counts.groupBy("id").agg(entries, F.sum("n").alias("_total"))
    freqs = F.transform("_entries.n", lambda n: n / F.col("_total"))
    return per_entity.select("id", F.struct(F.col("_entries.word").alias("words"), freqs.alias("freqs")).alias("features"))


def dense_features(features: Column | str, k: int) -> Column:
    """All k numbers of a sparse row, zeros included: for outputs that need them."""
    row = F.col(features) if isinstance(features, str) else features
    words, freqs = row["words"], row["freqs"]

    # Zeros between neighbouring words are filled in, so a row costs its words plus k.
    def with_gap(word, i):
        gap = F.array_repeat(F.lit(0.0), word - F.coalesce(F.get(words, i - 1), F.lit(-1)) - 1)
        return F.concat(gap, F.array(F.get(freqs, i)))

    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(-1))
    return F.concat(F.flatten(F.transform(words, with_gap)), F.array_repeat(F.lit(0.0), F.lit(k - 1) - last))


def dense_rows(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``features`` as an array of k numbers."""
    return rows.withColumn("features", dense_features("features", k))


def histogram_dense(counts: DataFrame, k: int) -> DataFrame:
    """``(id, features)``: k frequencies per entity, zeros included."""
    return dense_rows(histogram_sparse(counts), k)


def histogram_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """``(*columns, word, freq)`` of the words that occur in sparse rows."""
    cell = F.explode(F.arrays_zip(F.col("features.words"), F.col("features.freqs")))
    return rows.select(*columns, cell.alias("_cell")).select(
        *columns, F.col("_cell.words").alias("word"), F.col("_cell.freqs").alias("freq")
    )


def with_empty_entities(entities: DataFrame, histograms: DataFrame, k: int) -> DataFrame:
    """All entities; those without descriptors get an all-zero dense or an empty sparse histogram."""
    kind = histograms.schema["features"].dataType
    if isinstance(kind, T.StructType):
        zeros = F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in kind.fields])
    else:
        zeros = F.array_repeat(F.lit(0.0), k)
    return entities.select("id").join(histograms, "id", "left").select(
        "id", F.coalesce("features", zeros).alias("features")
    )
