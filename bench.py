"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from glyphist.operators.classifier import confusion_of, score_rows, train_hinge_descent  # noqa: E402
from glyphist.operators.codebook import (  # noqa: E402
    assign_words,
    codebook_cost,
    codebook_of,
    first_descriptors,
    lloyd,
    train_codebook,
)
from glyphist.operators.evaluate import class_report, label_areas, margin_areas  # noqa: E402
from glyphist.operators.labels import label_entities, label_map  # noqa: E402
from glyphist.operators.split import prefix_split  # noqa: E402
from glyphist.operators.training import training_rows  # noqa: E402
from glyphist.plans.end_to_end import histograms  # noqa: E402
from glyphist.plans.registry import line_item_descriptors, order_tags  # noqa: E402
from glyphist.session import configure, ship_with_tasks, spread, stored  # noqa: E402

WORDS, ITERATIONS, DESCENT_STEPS = 100, 15, 200


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = (
        builder.config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_with_tasks()

    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    items, tags = line_item_descriptors(spark, folder), order_tags(spark, folder)
    # One small pass so that the first timing does not measure JVM and worker start-up.
    run(assign_words(items, first_descriptors(items, 2, "id", "pos", "features")))

    split = timed("split_entities", lambda: prefix_split(tags, "id", 0.8))
    train = items.filter(split.is_train("id"))
    codebook = timed("kmeans_train_k100", lambda: codebook_of(train_codebook(train, WORDS, ITERATIONS)))
    given = first_descriptors(train, WORDS, "id", "pos", "features")
    timed("lloyd_15_steps_k100", lambda: lloyd(train, given, ITERATIONS))
    timed("assign_and_cost_k100", lambda: codebook_cost(assign_words(items, codebook)).collect())
    timed("histograms_k100", lambda: run(histograms(items, codebook)))

    def labelled_rows():
        labelled = label_entities(tags, label_map(tags))
        return stored(split.apply(training_rows(labelled, histograms(items, codebook)), "id"), "rows")

    rows = timed("assign_histogram_label_join_k100", labelled_rows)
    fitted = timed(
        "svm_descent_200_steps_5_classes",
        lambda: train_hinge_descent(spread(rows.filter("split = 'train'")), range(5), WORDS, DESCENT_STEPS),
    )
    scores = score_rows(rows.filter(F.col("split") == "test"), fitted.with_threshold(-0.09))
    limited = fitted.with_threshold(-0.09)
    timed("score_and_report", lambda: label_areas(class_report(confusion_of(rows.filter("split = 'test'"), limited))).collect())
    timed("margin_areas", lambda: margin_areas(scores).collect())
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "codebook_histogram_classification_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
