"""Ranks over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.session import stored

# monotonically_increasing_id() keeps the row number of a partition in the low bits.
SLOT_BITS = 33
SLOT_MASK = (1 << SLOT_BITS) - 1


def ordered_slots(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range-sort ``df`` and record partition and row number as ``_slot``.

    Range bounds come from sampling, so a second run could cut elsewhere; the result is
    written to the shared folder and every later reader sees the same slots.
    """
    return stored(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "slots")


def slot_partition() -> Column:
    return F.shiftright(F.col("_slot"), SLOT_BITS)


def partition_sizes(slotted: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows) in order: one small row per partition."""
    counts = slotted.groupBy(slot_partition().alias("p")).agg(F.count("*").alias("n"))
    return sorted((r.p, r.n) for r in counts.collect())


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add the 0-based global rank in the given order."""
    slotted = ordered_slots(df, *order)
    before, offsets = 0, []
    for partition, n in partition_sizes(slotted):
        offsets.append((partition, before))
        before += n
    # One row per partition: bounded by the number of shuffle partitions.
    starts = df.sparkSession.createDataFrame(offsets, "p bigint, start bigint")
    rank = F.col("start") + F.col("_slot").bitwiseAND(F.lit(SLOT_MASK))
    return (
        slotted.withColumn("p", slot_partition())
        .join(F.broadcast(starts), "p")
        .select(*df.columns, rank.alias(name))
    )
