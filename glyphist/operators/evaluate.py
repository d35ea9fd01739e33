"""Confusion counts, ratios, and ROC / PR areas of all classes at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphist.functions.text import fixed_decimals
from glyphist.operators.joins import lookup_join
from glyphist.session import stored

COUNTS = ("tp", "tn", "fp", "fn")


def confusion(predictions: DataFrame) -> DataFrame:
    """``(class, tp, tn, fp, fn)`` from 0/1 columns ``predicted`` and ``actual``."""
    hit, real = F.col("predicted") == 1, F.col("actual") == 1
    miss, other = F.col("predicted") == 0, F.col("actual") == 0
    return predictions.groupBy("class").agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(miss & other).alias("tn"),
        F.count_if(hit & other).alias("fp"),
        F.count_if(miss & real).alias("fn"),
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, accuracy and F-measure; NULL where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    ratios = counts.select(
        "class",
        *COUNTS,
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )
    p, r = F.col("precision"), F.col("recall")
    return ratios.withColumn("fmeasure", F.try_divide(2 * (p * r), p + r))


def report_lines(report: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(class, line)``: the report of each class as text, four lines in one.

    Counts, percentages with two decimals and F as a plain ratio; then the two areas if the
    report has them. ``labels (tag, label)`` gives the category its name; without it, or
    for a class that it lacks, the class number is the name.
    """

    def number(column: Column) -> Column:
        return F.coalesce(fixed_decimals(column, 2), F.lit("NaN"))

    named = report.withColumn("_tag", F.col("class").cast("string"))
    if labels is not None:
        known = labels.select(F.col("label").alias("class"), F.col("tag").alias("_name"))
        named = lookup_join(report, known, "class").withColumn("_tag", F.coalesce("_name", F.col("class").cast("string")))
    # The wording of the report.
    parts = [
        F.lit("Category:"), F.col("_tag"),
        F.lit(" true positives: "), F.col("tp"),
        F.lit(" true negatives: "), F.col("tn"),
        F.lit(" false positives: "), F.col("fp"),
        F.lit(" false negatives: "), F.col("fn"),
        F.lit("\nprecision:"), number(F.col("precision") * 100),
        F.lit("% recall:"), number(F.col("recall") * 100),
        F.lit("% accuracy:"), number(F.col("accuracy") * 100),
        F.lit("% fmeasure:"), number(F.col("fmeasure")),
    ]
    if {"auroc", "aupr"} <= set(report.columns):
        parts += [
            F.lit("\nArea under ROC = "), fixed_decimals(F.col("auroc"), 6),
            F.lit("\nArea under PR curve = "), fixed_decimals(F.col("aupr"), 6),
        ]
    return named.select("class", F.concat(*parts).alias("line"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def label_areas(counts: DataFrame) -> DataFrame:
    """Adds ``auroc`` and ``aupr`` when the score is the predicted label itself.

    Two score values leave one operating point, so the areas follow from the confusion
    counts. Empty denominators count as MLlib counts them: rates 0, precision 1.
    """
    tp, fp = F.col("tp"), F.col("fp")
    pos, neg = tp + F.col("fn"), fp + F.col("tn")
    tpr, fpr = _rate(tp, pos), _rate(fp, neg)
    end_tpr, end_fpr = _rate(pos, pos), _rate(neg, neg)
    roc = fpr * tpr / 2 + (end_fpr - fpr) * (tpr + end_tpr) / 2 + (1 - end_fpr) * (end_tpr + 1) / 2
    first, base = F.try_divide(tp, tp + fp), pos / (pos + neg)
    pr = F.when(first.isNull(), end_tpr * base).otherwise(tpr * first + (end_tpr - tpr) * (first + base) / 2)
    return counts.select("*", roc.alias("auroc"), pr.alias("aupr"))


def _running_totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running ``pos`` and ``neg`` of each class over the sorted rows of one range."""
    last, carry = None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        classes = batch.column("class").to_numpy(zero_copy_only=False)
        counts = np.stack([batch.column(c).to_numpy() for c in ("pos", "neg")])
        starts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
        runs = counts.cumsum(axis=1)
        before = np.where(starts > 0, runs[:, starts - 1], 0)
        if classes[0] == last:
            before[:, 0] -= carry
        runs -= np.repeat(before, np.diff(np.append(starts, len(classes))), axis=1)
        last, carry = classes[-1], runs[:, -1].copy()
        columns = [*batch.columns, pa.array(runs[0]), pa.array(runs[1])]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_pos_run", "_neg_run"])


def margin_areas(predictions: DataFrame) -> DataFrame:
    """``(class, auroc, aupr)`` over all distinct margins.

    Equal margins are merged first. The merged rows are range-sorted by class and margin,
    the only shuffle of them; running totals are taken as each range is written, and the
    totals of the ranges before it are added: no class passes through one task.
    """
    real = F.col("actual") == 1
    merged = predictions.groupBy("class", "margin").agg(
        F.count_if(real).alias("pos"), F.count_if(~real).alias("neg")
    )
    ordered = merged.orderBy("class", F.desc("margin")).withColumn("_range", F.spark_partition_id())
    kind = merged.schema["class"].dataType.simpleString()
    schema = f"class {kind}, margin double, pos long, neg long, _range int, _pos_run long, _neg_run long"
    ranges = stored(ordered.mapInArrow(_running_totals, schema), "margins")
    per_range = ranges.groupBy("class", "_range").agg(F.max("_pos_run").alias("_pos"), F.max("_neg_run").alias("_neg"))
    # One row per range and class: a class has at most as many rows as there are ranges.
    whole = Window.partitionBy("class")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        "class",
        "_range",
        F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("_pos_start"),
        F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_neg_start"),
        F.sum("_pos").over(whole).alias("_pos_all"),
        F.sum("_neg").over(whole).alias("_neg_all"),
    )
    points = lookup_join(ranges, starts, ["class", "_range"], "inner")
    tp, fp = F.col("_pos_start") + F.col("_pos_run"), F.col("_neg_start") + F.col("_neg_run")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    tpr, tpr0 = _rate(tp, F.col("_pos_all")), _rate(tp0, F.col("_pos_all"))
    fpr, fpr0 = _rate(fp, F.col("_neg_all")), _rate(fp0, F.col("_neg_all"))
    precision = tp / (tp + fp)
    # The curve starts at recall 0 with the precision of its first point.
    precision0 = F.coalesce(F.try_divide(tp0, tp0 + fp0), precision)
    last_fpr, last_tpr = _rate(F.max("_neg_all"), F.max("_neg_all")), _rate(F.max("_pos_all"), F.max("_pos_all"))
    return points.groupBy("class").agg(
        (F.sum((fpr - fpr0) * (tpr + tpr0) / 2) + (1 - last_fpr) * (last_tpr + 1) / 2).alias("auroc"),
        F.sum((tpr - tpr0) * (precision + precision0) / 2).alias("aupr"),
    )
