"""How filters overlap: what each removes in every order, from the counts of failing sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.llm.exact_duplicates import with_first_copy
from glyphist.llm.steps import Steps

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
WEIGHTS = ("n", "good", "toxic")

AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failing(docs: DataFrame, steps: Steps) -> DataFrame:
    """``(doc_id, part, mask)``: bit f of ``mask`` is set if the text fails filter f of ``FILTERS``.

    The part is the language, null as the empty string. A null text is empty. The last
    filter fails for texts equal, byte by byte, to one with a smaller id anywhere in the
    table; a null id is neither smaller nor larger than any.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    words = texts.withColumn("_words", F.filter(F.split("body", r"[ \x09-\x0d]+"), lambda w: w != ""))
    n_words = F.size("_words")
    fails = [
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")) < DISTINCT_PERCENT * n_words,
        100 * F.regexp_count("body", F.lit("[A-Z]")).cast("long") > UPPER_PERCENT * F.length("body"),
        F.col("body").rlike(SYMBOLS),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    copies = with_first_copy(words.select("doc_id", "part", mask.alias("mask"), "body"), steps)
    later = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False)).cast("int")
    return copies.select("doc_id", "part", (F.col("mask") + later * (1 << len(fails))).alias("mask"))


def failing_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the set of filters they fail.

    A document is good or toxic if any label row of its id says so; null ids have no labels.
    """
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marks = marks.filter("good = 1 OR toxic = 1")
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in WEIGHTS[1:]]
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


class Orders:
    """All orders of ``n`` filters against all sets of failing ones, as matrices."""

    def __init__(self, n: int):
        self.orders = np.array(list(permutations(range(n))))
        # Inverse permutations: at which step an order applies a filter.
        self.position = np.argsort(self.orders, axis=1)
        self.fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1
        never = n
        distance = np.where(self.fails, 0, never)
        # Min-plus product: the step at which a set of failing filters removes a document, or never.
        reach = (self.position[:, None, :] + distance[None, :, :]).min(axis=2)
        self.removal = np.minimum(reach, never)

    def removed(self, weights: np.ndarray) -> np.ndarray:
        """Weight removed by [order, step], from one weight per failing set."""
        n_orders, n = self.orders.shape
        result = np.zeros((n_orders, n + 1), np.int64)
        rows = np.repeat(np.arange(n_orders)[:, None], len(weights), axis=1)
        np.add.at(result, (rows, self.removal), np.broadcast_to(weights, rows.shape))
        return result[:, :-1]

    def redundant(self, weights: np.ndarray) -> np.ndarray:
        """Weight that fails the filter of [order, step] but went at an earlier step."""
        earlier = self.removal[:, :, None] < self.position[:, None, :]
        by_filter = (earlier & self.fails[None, :, :]).transpose(0, 2, 1) @ weights
        return np.take_along_axis(by_filter, self.orders, axis=1)


def audited(names: str, part: str, counts: dict[int, tuple[int, int, int]]) -> dict[str, np.ndarray | list]:
    """The audit rows of one part, from (n, good, toxic) by failing set."""
    orders = Orders(len(names))
    weights = np.zeros((len(WEIGHTS), 1 << len(names)), np.int64)
    for mask, values in counts.items():
        weights[:, mask] = values
    removed, good, toxic = (orders.removed(w) for w in weights)
    alone = weights[0][1 << np.arange(len(names))]
    # What each filter removes, over all orders.
    shapley = np.take_along_axis(removed, orders.position, axis=1).sum(axis=0)
    n_orders, n = orders.orders.shape
    labels = ["".join(names[f] for f in order) for order in orders.orders]
    return {
        "part": [part] * (n_orders * n),
        "filter_order": np.repeat(labels, n),
        "step": np.tile(np.arange(1, n + 1, dtype=np.int32), n_orders),
        "kept": (weights[0].sum() - np.cumsum(removed, axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": orders.redundant(weights[0]).ravel(),
        "unique_fails": alone[orders.orders].ravel(),
        "good_lost": good.ravel(),
        "toxic_lost": toxic.ravel(),
        "shapley": shapley[orders.orders].ravel(),
    }


def interaction_audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Rows of ``AUDIT_SCHEMA``: one per part, order of ``names`` and step, zeros included.

    ``counts`` has at most one row per part and failing set, as ``failing_counts`` makes it.
    """
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("sets"))

    def audit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of_mask = {s["mask"]: tuple(s[w] for w in WEIGHTS) for s in row["sets"]}
                columns = audited(names, row["part"], of_mask)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return sets.mapInArrow(audit, AUDIT_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs (doc_id, text, lang)``, by language.

    Every document counts, repeated rows too. An empty table gives no rows, an empty label table
    zeros for what is lost; other columns are not read. Documents become one narrow row
    each, and counts of at most 32 failing sets a part before orders are looked at.
    """
    rows = failing(docs, Steps(docs.sparkSession, "audit"))
    return interaction_audit(failing_counts(rows, labels))
