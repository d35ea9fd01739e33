"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.session import stored

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 * 1024 * 1024
SALTS = 64
# A key below this many rows is no burden for one task.
HOT_KEY_ROWS = 1_000_000
HOT_KEY_SHARE = 0.001


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` stays within both bounds; reads at most ``max_rows + 1`` rows."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, bytes_ = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (bytes_ or 0) <= max_bytes


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_MAX_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a lookup table whose key is unique.

    Broadcast if the table passes the size check. Otherwise both sides are shuffled on
    the key plus a salt, so that a hot key of ``df`` is spread over ``salts`` tasks.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if is_small(table, max_rows):
        return df.join(F.broadcast(table), keys, how)
    # The row number parts rows that are equal in every column.
    own = F.xxhash64(*df.columns, F.monotonically_increasing_id())
    salted = df.withColumn("_salt", F.pmod(own, F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_KEY_ROWS, share: float = HOT_KEY_SHARE) -> list:
    """Keys with at least ``min_rows`` rows and ``share`` of all rows: at most 1/share.

    ``freqItems`` never misses a key above the share, and keeps at most 1/share
    candidates per task; their exact counts are checked afterwards. Neither step
    shuffles the rows.
    """
    row = df.agg(F.count("*").alias("n")).first()
    if row.n < min_rows:
        return []
    candidates = df.filter(F.col(key).isNotNull()).freqItems([key], share).first()[0]
    if not candidates:
        return []
    needed = max(min_rows, share * row.n)
    counts = df.filter(F.col(key).isin(candidates)).groupBy(key).count()
    return [r[key] for r in counts.filter(F.col("count") >= needed).collect()]


def join_on_entity(
    many: DataFrame, one: DataFrame, key: str = "id", min_rows: int = HOT_KEY_ROWS, share: float = HOT_KEY_SHARE
) -> DataFrame:
    """Inner join where ``key`` is unique in ``one`` and may repeat, even heavily, in ``many``.

    Without hot keys this is the ordinary join, which reuses the key partitioning that
    ``one`` has from its aggregation. Otherwise ``one`` is written first; rows of hot keys
    meet a broadcast of their few rows of it, or are salted if those are large.
    """
    hot = hot_keys(many, key, min_rows, share)
    if not hot:
        return many.join(one, key, "inner")
    # Both branches read the written rows, so ``one`` is computed once, whatever it takes.
    one = stored(one, "entities")
    is_hot = F.col(key).isin(hot)
    # At most 1/share keys, one row each; their bytes are checked before they are sent.
    hot_part = lookup_join(many.filter(is_hot), one.filter(is_hot), key, "inner")
    return many.filter(~is_hot).join(one.filter(~is_hot), key, "inner").unionByName(hot_part)
