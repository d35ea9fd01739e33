"""Tags from JSON metadata, in files or in a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphist.functions.paths import base_name
from glyphist.functions.text import first_tag
from glyphist.sources.manifest import read_files


def read_metadata(
    spark: SparkSession, folders: str | list[str], glob: str | None = None, skip_hidden: bool = False
) -> DataFrame:
    """``(id, tag)``, one row per file of the folders; the id is the file's base name.

    A file holds one JSON object. A missing, empty or malformed tag list gives a NULL tag, and
    so do an empty file and one that holds something else. Very many small files are better
    kept as a table of JSON text, see ``tags_from_json``.
    """
    names = [folders] if isinstance(folders, str) else folders
    files = reduce(DataFrame.unionByName, [read_files(spark, f, glob, skip_hidden) for f in names])
    return files.select(base_name("path").alias("id"), first_tag(F.col("content").cast("string")).alias("tag"))


def tags_from_json(df: DataFrame, id_col: str, json: Column | str) -> DataFrame:
    """``(id, tag)`` from a column of JSON text."""
    return df.select(F.col(id_col).alias("id"), first_tag(json).alias("tag"))
