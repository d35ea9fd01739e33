"""Exact duplicates: groups of one 128-bit content hash, split where their bytes differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.llm.steps import Steps

# Hashes sent to all tasks at most (16 bytes each, some 100 in a hash table); beyond, whole texts are grouped.
BROADCAST_NAMES = 200_000


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty. Single spaces are not matched at all."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0d]{2,}|[\x09-\x0d]", " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _repeated(rows: DataFrame, steps: Steps) -> DataFrame:
    """``(name, n, keep_id, keep_row)`` of names with several rows; combined before the shuffle."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    groups = rows.groupBy("name").agg(F.count("*").alias("n"), least).filter("n > 1")
    groups = groups.select("name", "n", F.col("least.doc_id").alias("keep_id"), F.col("least.row").alias("keep_row"))
    return steps.keep(groups, "repeated")


def _collided(texts: DataFrame, repeated: DataFrame, steps: Steps) -> DataFrame:
    """Names that stand for several texts, by comparing the bytes of all texts of a repeated name.

    Copies become one row in each task before anything is shuffled, so a group of any size
    brings one text a task. Few repeated names are sent to all tasks, and texts of other
    names stay where they are; with many, all different texts are grouped.
    """
    if repeated.count() <= BROADCAST_NAMES:
        texts = texts.join(F.broadcast(repeated.select("name")), "name", "left_semi")
    several = texts.distinct().groupBy("name").agg(F.count("*").alias("texts")).filter("texts > 1")
    return steps.keep(several.select("name"), "collided")


def with_first_copy(
    texts: DataFrame, steps: Steps, hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """Groups of rows with equal ``body``: adds ``group_size``, ``keep_id`` and ``kept``, drops ``body``.

    ``texts`` has doc_id, body (not null) and any narrow columns, which are kept. ``keep_id``
    is the least id of the group (null ids come last), and exactly one row of a group is
    ``kept``: of rows that repeat that id, the first one as read. Rows are grouped by hash;
    where the bytes of a group differ, the text itself becomes part of the name. A group may
    hold any share of the rows: only its least row is aggregated, and the join that gives it to
    the group's rows is one that Spark can split.
    """
    named = texts.withColumn("name", hashed(F.col("body")))
    row = F.monotonically_increasing_id().alias("row")
    rows = steps.keep(named.drop("body").select("*", row), "rows")
    repeated = _repeated(rows, steps)
    collided = _collided(named.select("name", "body"), repeated, steps)
    if collided.limit(1).count():
        apart = named.join(collided, "name", "left_semi").withColumn("name", F.concat("name", F.encode("body", "utf-8")))
        apart = apart.drop("body").select("*", row)
        rows = steps.keep(rows.join(collided, "name", "left_anti").unionByName(apart), "rows")
        repeated = _repeated(rows, steps)
    joined = rows.join(repeated, "name", "left")
    alone = F.col("n").isNull()
    return joined.select(
        *[c for c in rows.columns if c not in ("name", "row")],
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal if their normalised forms have the same bytes; null counts as empty, and
    texts of white space alone are equal to a single space, not to the empty text. Of equal
    texts the row with the least id stays; null ids come after all others, and a repeated row
    stays once. An empty table gives no rows; other columns are not read.
    """
    body = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), body.alias("body"))
    grouped = with_first_copy(texts, Steps(docs.sparkSession, "copies"))
    return grouped.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns; they are written once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    texts = docs.select(F.col(id_col).alias("doc_id"), whole, normalised(F.col(text_col)).alias("body"))
    return with_first_copy(texts, Steps(docs.sparkSession, "copies")).filter("kept").select("whole.*")
