"""Connected components of any number of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.llm.steps import Steps


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of ``edges (u, v)`` but the roots themselves.

    The root is the least node of the component. Each round links every node's larger
    neighbours to its least neighbour, then every node and its smaller neighbours to the least
    of them; rounds are few (about the logarithm of the longest path) and end when the
    edges no longer change. Only least nodes are aggregated, which combines before the
    shuffle and are written; a node with very many edges then meets one row in a join that
    Spark can split.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = steps.keep(ordered.distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = steps.keep(least, "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = steps.keep(large, "edges")
        least = steps.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").union(least.select("u", "m"))
        following = steps.keep(small.distinct(), "edges")
        steps.drop(current, large)
        before, current, state = state, following, _state(following)
        if state == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
