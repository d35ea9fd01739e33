"""Saving and loading codebooks, classifiers and label maps as Parquet tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from glyphist.schema import CLASSIFIER_SCHEMA, CODEBOOK_SCHEMA, Codebook, LinearModel


def save_codebook(codebook: Codebook, spark: SparkSession, path: str) -> None:
    codebook.to_df(spark).write.mode("overwrite").parquet(path)


def load_codebook(spark: SparkSession, path: str) -> Codebook:
    return Codebook.from_df(spark.read.schema(CODEBOOK_SCHEMA).parquet(path))


def save_kmeans(model: KMeansModel, path: str) -> None:
    """The Spark ML model itself, for use outside this library."""
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def save_classifier(model: LinearModel, spark: SparkSession, path: str) -> None:
    model.to_df(spark).write.mode("overwrite").parquet(path)


def load_classifier(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.from_df(spark.read.schema(CLASSIFIER_SCHEMA).parquet(path))


def save_labels(labels: DataFrame, path: str) -> None:
    labels.select("tag", "label").write.mode("overwrite").parquet(path)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tag string, label double").parquet(path)
