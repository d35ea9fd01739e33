"""Entity ids and metadata paths derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column | str) -> Column:
    """File name without directory and without its last extension."""
    name = F.regexp_replace(path, r"(?s)^.*[/\\]", "")
    return F.regexp_replace(name, r"\.[^.]*$", "")


def metadata_name(path: Column | str) -> Column:
    """Every lower-case ``.jpg`` becomes ``.json``; other names stay as they are."""
    column = F.col(path) if isinstance(path, str) else path
    return F.replace(column, F.lit(".jpg"), F.lit(".json"))
