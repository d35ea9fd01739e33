"""Categories and their numeric labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.operators.joins import lookup_join
from glyphist.operators.ordering import with_rank


def distinct_tags(tags: DataFrame) -> DataFrame:
    """Every category once; missing tags are none."""
    return tags.select("tag").filter(F.col("tag").isNotNull()).distinct()


def label_map(tags: DataFrame) -> DataFrame:
    """``(tag, label)``: 0.0, 1.0, ... in alphabetical order of the tags."""
    ranked = with_rank(distinct_tags(tags), "tag")
    return ranked.select("tag", F.col("rank").cast("double").alias("label"))


def label_for_tag(labels: DataFrame, tag: str) -> float | None:
    row = labels.filter(F.col("tag") == tag).first()
    return None if row is None else row.label


def label_entities(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, tag, label)``; the label of an unknown tag is NULL."""
    return lookup_join(tags, labels, "tag", "left").select("id", "tag", "label")


def label_drops(labelled: DataFrame) -> DataFrame:
    """How many entities have no tag, an unknown tag, and a label."""
    return labelled.agg(
        F.count_if(F.col("tag").isNull()).alias("n_no_tag"),
        F.count_if(F.col("tag").isNotNull() & F.col("label").isNull()).alias("n_unknown_tag"),
        F.count("label").alias("n_labelled"),
    )
