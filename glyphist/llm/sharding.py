"""Contiguous shards of nearly equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphist.session import stored

SHARDS = 16


def byte_size_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, first_byte)`` for every row.

    Rows are ordered by id, checksum and size; shard s takes the rows whose middle byte
    lies in the s-th of ``shards`` equal parts of all bytes. The law is ``bytes``: shard
    sizes differ by no more than the largest row. ``slot`` numbers the rows of a shard
    from 0 without gaps, ``first_byte`` is the place of the row in the whole table.

    Only ids and sizes move: one range exchange, whose partitions are summed up to one
    total each; the prefix sums of those totals (as many as partitions) place every
    partition, and running sums inside a partition place its rows. Repeated ids and
    wholly equal rows are told apart by a row number, so that no key fills a partition.

    Null and empty texts have size 1, null ids come first; an empty table gives no rows.
    More columns of ``docs``, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("_row", F.monotonically_increasing_id())
    order = ["doc_id", "text_crc32", "size", "_row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample: written, so that all later steps see the same parts.
    placed = stored(
        sized.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "sharding"
    )
    # One row for each partition, however many rows the table has.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("size").alias("bytes"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_start"),
        F.sum("bytes").over(Window.partitionBy()).alias("_total"),
    )
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    sharded = (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("first_byte", first)
        .withColumn("shard", F.expr(f"((2 * first_byte + size) * {int(shards)}) div (2 * _total)").cast("int"))
        .withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    )
    # A shard takes a run of rows from each partition: (partition, shard) pairs are few.
    runs = placed_runs(sharded)
    return sharded.join(F.broadcast(runs), ["_part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_place") + F.col("_shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "first_byte",
    )


def placed_runs(sharded: DataFrame) -> DataFrame:
    """``(_part, shard, _shift)``: what turns a place in a partition into a slot.

    At most partitions + shards rows, as both follow the same order.
    """
    runs = sharded.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_place").alias("lowest"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        "_part", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("lowest")).alias("_shift")
    )
