"""Train/test splits that are a filter on the entity key.

Once the split is known as a predicate on the key, every table with that key is split
by a projection: neither the manifest nor the descriptors need a join or a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PrefixSplit:
    """The first ``n_train`` of ``n`` rows, in key order, are the training part.

    Rows with equal keys are always in the same part.
    """

    n: int
    n_train: int
    last_key: Any
    key_type: T.DataType

    def is_train(self, key: Column | str) -> Column:
        column = F.col(key) if isinstance(key, str) else key
        if self.n_train == 0:
            return F.lit(False)
        return column <= F.lit(self.last_key).cast(self.key_type)

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("split", split_name(self.is_train(key)))


def split_name(is_train: Column) -> Column:
    return F.when(is_train, F.lit("train")).otherwise(F.lit("test"))


# Keys drawn to find a bracket around a rank, and how many keys the driver may be given at once.
SAMPLE_KEYS = 20_000
BRACKET_KEYS = 100_000


def _sorted(keys: DataFrame, key: str) -> list:
    """All keys of a small frame in Spark's order; each task sends its own once."""
    return keys.agg(F.sort_array(F.collect_list(key)).alias("keys")).first().keys


def key_at_rank(keys: DataFrame, key: str, rank: int, n: int) -> tuple[Any, int]:
    """The key of 0-based ``rank`` among ``n`` non-NULL keys, and the number of keys up to and with it.

    No key is sorted or moved. A sample gives two keys around the rank; one scan counts the
    keys below, at and between them, which tells where the rank lies; the next round draws
    from the open interval that holds it. An interval of at most ``BRACKET_KEYS`` keys goes to
    the driver. Two scans a round, each round some 25 times fewer keys: one round for 2.5
    million, two for 60 million. A key that repeats is found as an end, however often it does.
    """
    kind = keys.schema[key].dataType
    column, below, inside, seed = F.col(key), 0, n, 0
    while inside > BRACKET_KEYS:
        drawn = _sorted(keys.sample(min(1.0, SAMPLE_KEYS / inside), seed), key)
        seed += 1
        if not drawn:
            continue
        place, far = (rank - below) / inside * len(drawn), 2.5 * math.sqrt(len(drawn))
        low, high = (F.lit(drawn[min(max(int(x), 0), len(drawn) - 1)]).cast(kind) for x in (place - far, place + far))
        less, at_low, between, at_high = keys.agg(
            F.count_if(column < low),
            F.count_if(column == low),
            F.count_if((column > low) & (column < high)),
            F.count_if((column == high) & (low < high)),
        ).first()
        ends = [below + less, below + less + at_low]
        ends += [ends[1] + between, ends[1] + between + at_high]
        if ends[0] <= rank < ends[1]:
            return keys.select(low).first()[0], ends[1]
        if ends[2] <= rank < ends[3]:
            return keys.select(high).first()[0], ends[3]
        if rank < ends[0]:
            keys, inside = keys.filter(column < low), less
        elif rank < ends[2]:
            keys, below, inside = keys.filter((column > low) & (column < high)), ends[1], between
        else:
            keys, below, inside = keys.filter(column > high), ends[3], inside - (ends[3] - below)
    found = _sorted(keys, key)
    value = found[rank - below]
    last = rank - below
    while last + 1 < len(found) and found[last + 1] == value:
        last += 1
    return value, below + last + 1


def prefix_split(entities: DataFrame, key: str, fraction: float) -> PrefixSplit:
    """Exact split after floor(n * fraction) rows in key order.

    Keys may repeat: all rows with the key at the cut are training rows, so the training
    part can be larger than asked for by the copies of one key. NULL keys are no keys;
    they come last and are test rows. The keys are counted and the one at the cut is selected
    by ``key_at_rank``, with no sort of the table.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    keys = entities.select(key)
    n, n_keys = keys.agg(F.count("*"), F.count(key)).first()
    asked = math.floor(n * fraction)
    key_type = entities.schema[key].dataType
    if not asked or not n_keys:
        return PrefixSplit(n, 0, None, key_type)
    # A NULL at the cut: every row with a key is before it.
    last, n_train = key_at_rank(keys.filter(F.col(key).isNotNull()), key, min(asked, n_keys) - 1, n_keys)
    return PrefixSplit(n, n_train, last, key_type)


@dataclass(frozen=True)
class HashSplit:
    """Split by a hash of the key: no sort, no count, stable when entities are added.

    MD5 makes the choice reproducible in other engines; 32 of its bits give the place
    of a key in [0, 1).
    """

    fraction: float

    def is_train(self, key: Column | str) -> Column:
        column = F.col(key) if isinstance(key, str) else key
        place = F.conv(F.substring(F.md5(column.cast("string")), 1, 8), 16, 10).cast("bigint")
        return place < F.lit(math.floor(self.fraction * 2**32))

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("split", split_name(self.is_train(key)))
