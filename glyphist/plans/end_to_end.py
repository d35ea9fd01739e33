"""Split, codebook, histograms, labels, classifiers and evaluation in one run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphist.operators.classifier import (
    DEFAULT_ITERATIONS,
    DEFAULT_THRESHOLD,
    confusion_of,
    score_rows,
    top_scores,
    train_hinge_descent,
)
from glyphist.operators.codebook import assign_words, codebook_of, train_codebook
from glyphist.operators.evaluate import class_report, label_areas
from glyphist.operators.histogram import histogram_sparse, word_counts
from glyphist.operators.joins import lookup_join
from glyphist.operators.labels import label_entities, label_map
from glyphist.operators.restarts import train_restarts
from glyphist.operators.split import HashSplit, PrefixSplit, prefix_split
from glyphist.operators.training import training_rows
from glyphist.schema import Codebook, LinearModel
from glyphist.session import release, spread, stored
from glyphist.sources import models
from glyphist.sources.run_log import RunLog


@dataclass(frozen=True)
class Settings:
    train_fraction: float = 0.8
    words: int = 100
    codebook_iterations: int = 15
    runs: int = 1
    init_mode: str = "k-means||"
    classifier_iterations: int = DEFAULT_ITERATIONS
    threshold: float = DEFAULT_THRESHOLD
    # Write the descriptors once before use: worth it if extracting them is expensive.
    store_descriptors: bool = False
    category_thresholds: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Fitted:
    """What a run leaves; ``save_fitted`` keeps the models, ``release`` removes its rows."""

    split: PrefixSplit | HashSplit
    codebook: Codebook
    labels: DataFrame
    model: LinearModel
    rows: DataFrame
    log: RunLog

    def release(self) -> None:
        release(self.rows)


@dataclass(frozen=True)
class Models:
    """What new entities are classified with: codebook, label map and classifier."""

    codebook: Codebook
    labels: DataFrame
    model: LinearModel


def histograms(descriptors: DataFrame, codebook: Codebook) -> DataFrame:
    """Descriptors to sparse histograms, one row per entity."""
    return histogram_sparse(word_counts(assign_words(descriptors, codebook)))


def trained_codebook(settings: Settings) -> Callable[[DataFrame], Codebook]:
    def train(descriptors: DataFrame) -> Codebook:
        k, steps, mode = settings.words, settings.codebook_iterations, settings.init_mode
        if settings.runs == 1:
            return codebook_of(train_codebook(descriptors, k, steps, mode))
        return train_restarts(descriptors, k, steps, settings.runs, mode).codebook

    return train


def fit(
    descriptors: DataFrame,
    tags: DataFrame,
    settings: Settings = Settings(),
    make_codebook: Callable[[DataFrame], Codebook] | None = None,
    split: PrefixSplit | HashSplit | None = None,
) -> Fitted:
    """Train on the training part of the entities in ``tags (id, tag)``.

    Histograms of both parts come from one pass over ``descriptors`` and are written
    once; the classifier's many steps read only those rows. Without ``split`` the first
    part of the ids, in order, is the training part.
    """
    log = RunLog(descriptors.sparkSession)
    for name in ("train_fraction", "words", "codebook_iterations", "runs", "classifier_iterations", "threshold"):
        log.add("settings", name, getattr(settings, name))
    if settings.store_descriptors:
        with log.timed("descriptors"):
            descriptors = stored(descriptors, "descriptors")
    if split is None:
        with log.timed("split"):
            split = prefix_split(tags, "id", settings.train_fraction)
        log.add("split", "train_entities", split.n_train)
        log.add("split", "test_entities", split.n - split.n_train)

    with log.timed("codebook"):
        make_codebook = make_codebook or trained_codebook(settings)
        codebook = make_codebook(descriptors.filter(split.is_train("id")))
    log.add("codebook", "words", codebook.size)

    with log.timed("rows"):
        labels = label_map(tags.filter(split.is_train("id")))
        n_labels = labels.count()
        labelled = log.counted(
            label_entities(tags, labels),
            "labels",
            no_tag=F.count_if(F.col("tag").isNull()),
            unknown_tag=F.count_if(F.col("tag").isNotNull() & F.col("label").isNull()),
        )
        hists = histograms(log.counted(descriptors, "descriptors"), codebook)
        rows = split.apply(training_rows(labelled, hists), "id")
        rows = stored(log.counted(rows, "rows"), "rows")

    with log.timed("classifier"):
        train = spread(rows.filter(F.col("split") == "train"))
        # Labels are 0.0 .. n - 1, so the classes need not be collected.
        model = train_hinge_descent(train, range(n_labels), codebook.size, settings.classifier_iterations)
        model = model.with_threshold(settings.threshold).with_thresholds(
            thresholds_by_label(labels, settings.category_thresholds)
        )
    return Fitted(split, codebook, labels, model, rows, log)


def thresholds_by_label(labels: DataFrame, by_tag: dict[str, float]) -> dict[float, float]:
    """Thresholds given by category name, keyed by label; unknown names are left out."""
    if not by_tag:
        return {}
    found = labels.filter(F.col("tag").isin(list(by_tag))).collect()
    return {r.label: by_tag[r.tag] for r in found}


def evaluate(fitted: Fitted) -> DataFrame:
    """``(class, tp .. fn, precision .. fmeasure, auroc, aupr)`` on the test part."""
    test = fitted.rows.filter(F.col("split") == "test")
    return label_areas(class_report(confusion_of(test, fitted.model)))


def save_fitted(fitted: Fitted | Models, path: str) -> None:
    """Codebook, label map and classifier as three tables below ``path``."""
    spark = fitted.labels.sparkSession
    models.save_codebook(fitted.codebook, spark, f"{path}/codebook")
    models.save_labels(fitted.labels, f"{path}/labels")
    models.save_classifier(fitted.model, spark, f"{path}/classifier")


def load_fitted(spark: SparkSession, path: str) -> Models:
    return Models(
        models.load_codebook(spark, f"{path}/codebook"),
        models.load_labels(spark, f"{path}/labels"),
        models.load_classifier(spark, f"{path}/classifier"),
    )


def predict(fitted: Fitted | Models, descriptors: DataFrame, top: int | None = None) -> DataFrame:
    """``(id, class, tag, margin, predicted)`` of entities that may be new.

    With ``top``, the best categories of each entity and their ``rank``; otherwise all of
    them, a row per entity and category.
    """
    unlabelled = histograms(descriptors, fitted.codebook).withColumn("label", F.lit(None).cast("double"))
    if top is None:
        return named(score_rows(unlabelled, fitted.model).drop("actual"), fitted.labels)
    return named(top_scores(unlabelled, fitted.model, top).drop("label"), fitted.labels)


def evaluate_on(fitted: Fitted | Models, descriptors: DataFrame, tags: DataFrame) -> DataFrame:
    """As ``evaluate``, with category names, on entities with tags, by the label map of the models.

    Entities whose tag the models do not know, or that have no descriptor, are left out.
    """
    labelled = label_entities(tags, fitted.labels)
    rows = training_rows(labelled, histograms(descriptors, fitted.codebook))
    return named(label_areas(class_report(confusion_of(rows, fitted.model))), fitted.labels)


def named(by_class: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the category name ``tag`` of ``class``."""
    return lookup_join(by_class, labels.select(F.col("label").alias("class"), "tag"), "class")
