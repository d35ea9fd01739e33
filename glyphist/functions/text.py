"""JSON tags and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_tag(json: Column | str) -> Column:
    """First element of the ``tags`` array; NULL if absent, empty or not an array."""
    return F.get_json_object(json, "$.tags[0]")


def fixed_decimals(value: Column, digits: int) -> Column:
    """Half-even decimal text without thousands separators."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def libsvm_line(label: Column, features: Column, digits: int = 5) -> Column:
    """``label 1:v1 2:v2 ... N:vN `` with zeros written and a trailing space."""
    cells = F.transform(
        features,
        lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), fixed_decimals(v, digits)),
    )
    return F.concat(label.cast("double").cast("string"), F.lit(" "), F.array_join(cells, " "), F.lit(" "))
