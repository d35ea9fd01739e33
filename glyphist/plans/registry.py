"""Every operator as a query over the given tables: ``(spark, table folder) -> DataFrame``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphist.functions.vectors import dense_vector
from glyphist.operators import descriptors as desc
from glyphist.operators.classifier import score_rows, top_scores, train_hinge_descent, train_linear_svc
from glyphist.operators.codebook import (
    assign_words,
    assign_words_of_table,
    codebook_cost,
    codebook_of,
    first_descriptors,
    lloyd,
    train_codebook,
)
from glyphist.operators.evaluate import class_report, confusion, label_areas, margin_areas, report_lines
from glyphist.operators.histogram import (
    dense_rows,
    histogram_cells,
    histogram_dense,
    histogram_long,
    histogram_sparse,
    with_empty_entities,
    word_counts,
)
from glyphist.operators.labels import distinct_tags, label_drops, label_entities, label_map
from glyphist.operators.restarts import train_restarts
from glyphist.operators.split import HashSplit, prefix_split
from glyphist.operators.tables import store_by_entity
from glyphist.operators.training import class_rows, one_vs_rest, training_rows
from glyphist.plans.end_to_end import (
    Fitted,
    Settings,
    evaluate,
    evaluate_on,
    fit,
    histograms,
    load_fitted,
    save_fitted,
)
from glyphist.schema import Codebook, LinearModel, dimension_report
from glyphist.session import scratch_path, spread, stored
from glyphist.sources import binary, libsvm, manifest, models
from glyphist.sources.metadata import read_metadata, tags_from_json
from glyphist.sources.run_log import RunLog

# Words per codebook, steps and thresholds of the registered queries.
EMBEDDING_WORDS = 64
LINE_ITEM_WORDS = 32
LINE_WORDS = 16
EVENT_WORDS = 16
TABLE_BUCKETS = 16
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SCORE_THRESHOLD = 0.002
CLASS_THRESHOLDS = {0.0: -0.004, 2.0: 0.001, 4.0: 0.0, 7.0: 0.006}
END_TO_END = Settings(words=16, codebook_iterations=2, classifier_iterations=3, threshold=-0.09)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Descriptors and given codebooks ------------------------------------------------------


def wide_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, spread over all cores before the per-row work starts."""
    return spread(table(spark, sf, name).select(*columns))


def embedding_descriptors(spark, sf):
    vectors = wide_table(spark, sf, "embeddings", "vec_id", "embedding")
    return desc.sub_vectors(vectors, "vec_id", "embedding", 8, 8)


def line_item_descriptors(spark, sf):
    columns = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return desc.line_item_descriptors(wide_table(spark, sf, "lineitem", *columns))


def line_descriptors(spark, sf):
    return desc.line_descriptors(wide_table(spark, sf, "documents", "doc_id", "text"))


def event_descriptors(spark, sf):
    columns = ("user_id", "event_id", "value", "ts", "event_type")
    return desc.event_descriptors(wide_table(spark, sf, "events", *columns), EVENT_TYPES)


def given_codebook(descriptors: DataFrame, k: int) -> Codebook:
    return first_descriptors(descriptors, k, "id", "pos", "features")


def flat_features(df: DataFrame, width: int) -> DataFrame:
    values = [F.get("features", F.lit(j)).alias(f"f{j}") for j in range(width)]
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"), *values)


def codebook_rows(spark: SparkSession, codebook: Codebook, digits: int | None = None) -> DataFrame:
    rows = codebook.to_df(spark).select("word", F.posexplode("centroid").alias("j", "value"))
    return rows if digits is None else rows.withColumn("value", F.round("value", digits))


@query
def descriptors_embedding(spark, sf):
    return flat_features(embedding_descriptors(spark, sf), 8)


@query
def descriptors_lineitem(spark, sf):
    return flat_features(line_item_descriptors(spark, sf), 4)


@query
def descriptors_lines(spark, sf):
    return flat_features(line_descriptors(spark, sf), 6)


@query
def descriptors_events(spark, sf):
    return flat_features(event_descriptors(spark, sf), 2 + len(EVENT_TYPES))


def line_character_counts(text: str) -> np.ndarray:
    classes = [re.compile(c) for c in desc.LINE_CHARACTER_CLASSES]
    rows = []
    for line in text.split("\n"):
        counts = [len(c.findall(line)) for c in classes]
        rows.append([*counts, len(line) - sum(counts)])
    return np.array(rows, dtype=float)


@query
def descriptors_user_function(spark, sf):
    documents = wide_table(spark, sf, "documents", "doc_id", "text")
    return flat_features(desc.extracted(documents, "doc_id", "text", line_character_counts, 6), 6)


@query
def descriptor_dimensions(spark, sf):
    frames = {
        "embedding": embedding_descriptors(spark, sf),
        "lineitem": line_item_descriptors(spark, sf),
        "lines": line_descriptors(spark, sf),
        "events": event_descriptors(spark, sf),
    }
    reports = [dimension_report(df).select(F.lit(name).alias("kind"), "*") for name, df in frames.items()]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


# Manifest, split, metadata ------------------------------------------------------------


@query
def manifest_paths(spark, sf):
    return manifest.manifest(table(spark, sf, "pages"), "url")


def document_manifest(spark, sf):
    name = F.concat(F.lit("images/"), F.col("source"), F.lit("_"), F.format_string("%08d", "doc_id"), F.lit(".jpg"))
    return manifest.manifest(table(spark, sf, "documents").select(name.alias("file")), "file", "metadata")


@query
def manifest_metadata_dir(spark, sf):
    return document_manifest(spark, sf)


@query
def train_test_split(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    return prefix_split(customers, "c_custkey", 0.8).apply(customers, "c_custkey")


@query
def train_test_counts(spark, sf):
    paths = document_manifest(spark, sf)
    split = prefix_split(paths, "path", 0.8).apply(paths, "path")
    return split.groupBy("split").agg(F.count("*").alias("n"))


@query
def hash_split(spark, sf):
    return HashSplit(0.8).apply(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def path_lists_roundtrip(spark, sf):
    paths = document_manifest(spark, sf)
    target = scratch_path(spark, "path-lists")
    manifest.write_path_lists(prefix_split(paths, "path", 0.8).apply(paths, "path"), target)
    lists = [
        manifest.read_path_list(spark, target, split, kind).select(
            F.lit(split).alias("split"), F.lit(kind).alias("list"), "path"
        )
        for split in ("train", "test")
        for kind in ("entity", "metadata")
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])


@query
def manifest_roundtrip(spark, sf):
    paths = document_manifest(spark, sf)
    target = scratch_path(spark, "manifest")
    manifest.write_manifest(prefix_split(paths, "path", 0.8).apply(paths, "path"), target)
    return spark.read.parquet(target).select("id", "path", "meta_path", "split")


@query
def first_tag(spark, sf):
    customers = table(spark, sf, "customer")
    json = F.concat(
        F.lit('{"name": "'), F.col("c_name"), F.lit('", "tags": ["'), F.col("c_mktsegment"), F.lit('", "other"]}')
    )
    return tags_from_json(customers, "c_custkey", json)


@query
def first_tag_absent(spark, sf):
    """The properties of an event hold no tags; every fifth event is given some, an empty list or no list."""
    kind = F.col("event_id") % 25
    json = (
        F.when(kind == 0, F.concat(F.lit('{"tags": ["'), F.col("event_type"), F.lit('", "x"]}')))
        .when(kind == 5, F.lit('{"tags": []}'))
        .when(kind == 10, F.lit('{"tags": "click"}'))
        .when(kind == 15, F.lit('{"tags": ["'))
        .otherwise(F.col("props"))
    )
    return tags_from_json(table(spark, sf, "events"), "event_id", json)


# Labels -------------------------------------------------------------------------------


def document_tags(spark, sf):
    tag = F.concat_ws("/", "lang", "source")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tag.alias("tag"))


def order_tags(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))


def embedding_tags(spark, sf):
    tag = F.format_string("%03d", "label")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), tag.alias("tag"))


def labelled_training_documents(spark, sf):
    """All documents, labelled by the categories of documents of quality 1."""
    tags = document_tags(spark, sf)
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return label_entities(tags, label_map(tags.join(good, "id", "left_semi")))


@query
def distinct_categories(spark, sf):
    return distinct_tags(document_tags(spark, sf))


@query
def category_labels(spark, sf):
    return label_map(document_tags(spark, sf))


@query
def label_of_category(spark, sf):
    return label_map(order_tags(spark, sf)).filter(F.col("tag") == "3-MEDIUM")


@query
def entity_labels(spark, sf):
    return labelled_training_documents(spark, sf)


@query
def entity_label_drops(spark, sf):
    return label_drops(labelled_training_documents(spark, sf))


@query
def label_join(spark, sf):
    items = line_item_descriptors(spark, sf)
    hists = histograms(items, given_codebook(items, LINE_ITEM_WORDS))
    tags = order_tags(spark, sf)
    rows = training_rows(label_entities(tags, label_map(tags)), hists)
    return histogram_cells(rows, "id", "label")


@query
def label_join_bucketed(spark, sf):
    """Histograms and labels as tables by entity: the join and the training join move no rows."""
    items, tags = line_item_descriptors(spark, sf), order_tags(spark, sf)
    hists = store_by_entity(histograms(items, given_codebook(items, LINE_ITEM_WORDS)), TABLE_BUCKETS, name="histograms")
    labels = store_by_entity(label_entities(tags, label_map(tags)), TABLE_BUCKETS, name="labels")
    return histogram_cells(training_rows(labels, hists), "id", "label")


@query
def label_join_repeated_ids(spark, sf):
    """Every event labels its user, so ids repeat; frequent users take the hot-key path."""
    events = event_descriptors(spark, sf)
    hists = histograms(events, given_codebook(events, EVENT_WORDS))
    tags = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("tag"))
    rows = training_rows(label_entities(tags, label_map(tags)), hists, min_rows=20, share=0.006)
    cells = histogram_cells(rows, "id", "label")
    return cells.groupBy("id", "label", "word", "freq").agg(F.count("*").alias("copies"))


# Codebook and assignment --------------------------------------------------------------


def assigned(descriptors: DataFrame, k: int) -> DataFrame:
    return assign_words(descriptors, given_codebook(descriptors, k))


def assignment_rows(assignment: DataFrame) -> DataFrame:
    # Not rounded: both engines add the dimensions in the same order.
    return assignment.select("id", F.col("pos").cast("bigint").alias("pos"), "word", "dist")


@query
def assign_words_embedding(spark, sf):
    return assignment_rows(assigned(embedding_descriptors(spark, sf), EMBEDDING_WORDS))


@query
def assign_words_lineitem(spark, sf):
    return assignment_rows(assigned(line_item_descriptors(spark, sf), LINE_ITEM_WORDS))


@query
def codebook_centres(spark, sf):
    return codebook_rows(spark, given_codebook(embedding_descriptors(spark, sf), EMBEDDING_WORDS))


@query
def codebook_cost_embedding(spark, sf):
    items = embedding_descriptors(spark, sf)
    codebook = given_codebook(items, EMBEDDING_WORDS)
    cost = codebook_cost(assign_words(items, codebook))
    return cost.select(F.lit(codebook.size).alias("n_words"), "n_descriptors", F.round("wssse", 6).alias("wssse"))


@query
def lloyd_1(spark, sf):
    items = embedding_descriptors(spark, sf)
    return codebook_rows(spark, lloyd(items, given_codebook(items, EMBEDDING_WORDS), 1)[0], 6)


@query
def lloyd_3(spark, sf):
    items = embedding_descriptors(spark, sf)
    return codebook_rows(spark, lloyd(items, given_codebook(items, EMBEDDING_WORDS), 3)[0], 6)


@query
def lloyd_3_lineitem(spark, sf):
    items = line_item_descriptors(spark, sf)
    return codebook_rows(spark, lloyd(items, given_codebook(items, LINE_ITEM_WORDS), 3)[0], 6)


def training_facts(spark: SparkSession, descriptors: DataFrame, codebook: Codebook) -> DataFrame:
    """What must hold of any trained codebook, with the numbers it is held against.

    The cost is below that of the first k descriptors as centres, far below that of the single
    mean, and another step does not raise it; every descriptor has a word.
    """
    first = given_codebook(descriptors, codebook.size)
    mean = descriptors.select(F.posexplode("features").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v"))
    single = Codebook([[r.v for r in mean.orderBy("j").collect()]])

    def cost(book: Codebook) -> float:
        return codebook_cost(assign_words(descriptors, book)).first().wssse

    trained = cost(codebook)
    again = cost(lloyd(descriptors, codebook, 1)[0])
    counted = word_counts(assign_words(descriptors, codebook)).agg(F.sum("n").alias("n")).first().n
    single_cost, first_cost = cost(single), cost(first)
    row = (codebook.size, counted, round(single_cost, 6), trained < first_cost, trained < single_cost, again <= trained * (1 + 1e-12))
    schema = "n_words int, n_descriptors long, single_cost double, below_first boolean, below_single boolean, settled boolean"
    return spark.createDataFrame([row], schema)


@query
def kmeans_codebook(spark, sf):
    items = embedding_descriptors(spark, sf)
    return training_facts(spark, items, codebook_of(train_codebook(items, k=EMBEDDING_WORDS)))


@query
def kmeans_lineitem(spark, sf):
    items = line_item_descriptors(spark, sf)
    return training_facts(spark, items, codebook_of(train_codebook(items)))


@query
def kmeans_restarts(spark, sf):
    """Three runs in the same passes: the first is what it is alone, and the cheapest is taken."""
    items = embedding_descriptors(spark, sf)
    one = train_restarts(items, k=EMBEDDING_WORDS)
    best = train_restarts(items, k=EMBEDDING_WORDS, runs=3)
    cost = codebook_cost(assign_words(items, best.codebook)).first().wssse
    facts = training_facts(spark, items, best.codebook)
    return facts.withColumns(
        {
            "n_runs": F.lit(len(set(best.costs))),
            "first_alone": F.lit(abs(best.costs[0] - one.cost) <= 1e-9 * one.cost),
            "cheapest": F.lit(abs(cost - min(best.costs)) <= 1e-9 * cost),
        }
    )


@query
def kmeans_random_init(spark, sf):
    items = embedding_descriptors(spark, sf)
    return training_facts(spark, items, codebook_of(train_codebook(items, k=EMBEDDING_WORDS, init_mode="random")))


@query
def assign_words_in_blocks(spark, sf):
    """The codebook as a table, in blocks of 17 words."""
    items = embedding_descriptors(spark, sf)
    book = given_codebook(items, EMBEDDING_WORDS).to_df(spark)
    return assignment_rows(assign_words_of_table(items, book, max_bytes=17 * 8 * 8))


@query
def codebook_roundtrip(spark, sf):
    path = scratch_path(spark, "codebook")
    models.save_codebook(given_codebook(embedding_descriptors(spark, sf), EMBEDDING_WORDS), spark, path)
    return codebook_rows(spark, models.load_codebook(spark, path))


# Histograms ---------------------------------------------------------------------------


@query
def word_counts_embedding(spark, sf):
    return word_counts(assigned(embedding_descriptors(spark, sf), EMBEDDING_WORDS))


@query
def word_counts_lineitem(spark, sf):
    return word_counts(assigned(line_item_descriptors(spark, sf), LINE_ITEM_WORDS))


@query
def histogram_long_embedding(spark, sf):
    return histogram_long(word_counts_embedding(spark, sf))


@query
def histogram_long_lineitem(spark, sf):
    return histogram_long(word_counts_lineitem(spark, sf))


@query
def histogram_long_lines(spark, sf):
    return histogram_long(word_counts(assigned(line_descriptors(spark, sf), LINE_WORDS)))


@query
def histogram_long_events(spark, sf):
    return histogram_long(word_counts(assigned(event_descriptors(spark, sf), EVENT_WORDS)))


@query
def histogram_sparse_lineitem(spark, sf):
    return histogram_cells(histogram_sparse(word_counts_lineitem(spark, sf)), "id")


@query
def histogram_dense_embedding(spark, sf):
    dense = histogram_dense(word_counts_embedding(spark, sf), EMBEDDING_WORDS)
    return dense.select("id", F.posexplode("features").alias("word", "freq"))


@query
def histogram_dense_lineitem(spark, sf):
    dense = histogram_dense(word_counts_lineitem(spark, sf), LINE_ITEM_WORDS)
    return dense.select("id", F.posexplode("features").alias("word", "freq"))


@query
def histogram_with_empty(spark, sf):
    entities = order_tags(spark, sf).select("id")
    dense = histogram_dense(word_counts_lineitem(spark, sf), LINE_ITEM_WORDS)
    return with_empty_entities(entities, dense, LINE_ITEM_WORDS).select(
        "id", F.posexplode("features").alias("word", "freq")
    )


# Training rows, classifier ------------------------------------------------------------


def embedding_rows(spark, sf):
    """Labelled histograms of all embeddings."""
    tags = embedding_tags(spark, sf)
    return training_rows(label_entities(tags, label_map(tags)), histogram_sparse(word_counts_embedding(spark, sf)))


def contrast_model(rows: DataFrame) -> LinearModel:
    """Given weights: mean histogram of a class minus the mean of all, six decimals."""
    cells = dense_rows(rows, EMBEDDING_WORDS).select("label", F.posexplode("features").alias("j", "v"))
    overall = cells.groupBy("j").agg(F.avg("v").alias("all"))
    weights = (
        cells.groupBy("label", "j")
        .agg(F.avg("v").alias("own"))
        .join(overall, "j")
        .select(F.col("label").alias("class"), "j", F.round(F.col("own") - F.col("all"), 6).alias("w"))
    )
    per_class = weights.groupBy("class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda e: e["w"]).alias("weights")
    )
    return LinearModel.from_df(per_class.withColumn("threshold", F.lit(0.0)))


def rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.select("id", "class", F.round("margin", 9).alias("margin"), "predicted", "actual")


def contrast_scores(spark, sf):
    rows = embedding_rows(spark, sf)
    return score_rows(rows, contrast_model(rows).with_threshold(SCORE_THRESHOLD))


@query
def libsvm_lines(spark, sf):
    return libsvm.libsvm_lines(dense_rows(embedding_rows(spark, sf), EMBEDDING_WORDS))


@query
def libsvm_roundtrip(spark, sf):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm_lines(dense_rows(embedding_rows(spark, sf), EMBEDDING_WORDS), path)
    back = spark.read.format("libsvm").option("numFeatures", str(EMBEDDING_WORDS)).load(path)
    cells = back.select("label", F.posexplode(vector_to_array("features")).alias("word", "freq"))
    return cells.groupBy("label", "word", "freq").agg(F.count("*").alias("n"))


@query
def dense_vector_roundtrip(spark, sf):
    back = embedding_descriptors(spark, sf).select("id", "pos", vector_to_array(dense_vector("features")).alias("features"))
    return flat_features(back, 8)


@query
def binary_rows(spark, sf):
    return class_rows(embedding_rows(spark, sf), 2.0).select("id", "label", "y")


@query
def one_vs_rest_rows(spark, sf):
    return one_vs_rest(embedding_rows(spark, sf), range(10)).select("id", "class", "y")


@query
def linear_score(spark, sf):
    rows = embedding_rows(spark, sf)
    return rounded_scores(score_rows(rows, contrast_model(rows))).drop("predicted")


@query
def threshold_predict(spark, sf):
    return rounded_scores(contrast_scores(spark, sf))


@query
def top_classes(spark, sf):
    """The three best of ten classes; margins are those of ``linear_score``."""
    rows = embedding_rows(spark, sf)
    best = top_scores(rows, contrast_model(rows).with_threshold(SCORE_THRESHOLD), 3)
    return best.select("id", "label", "rank", "class", F.round("margin", 9).alias("margin"), "predicted")


@query
def category_thresholds(spark, sf):
    rows = embedding_rows(spark, sf)
    model = contrast_model(rows).with_threshold(SCORE_THRESHOLD).with_thresholds(CLASS_THRESHOLDS)
    return rounded_scores(score_rows(rows, model))


def weight_rows(spark, model: LinearModel, digits: int | None = None) -> DataFrame:
    rows = model.to_df(spark).select("class", F.posexplode("weights").alias("j", "w"))
    return rows if digits is None else rows.withColumn("w", F.round("w", digits))


@query
def svm_descent_3(spark, sf):
    model = train_hinge_descent(embedding_rows(spark, sf), range(10), EMBEDDING_WORDS, 3)
    return weight_rows(spark, model, 6)


def hinge_losses(rows: DataFrame, model: LinearModel) -> DataFrame:
    """``(class, n_rows, loss)``: the regularised mean hinge loss of every class."""
    norms = {float(c): 0.005 * float(w @ w) for c, w in zip(model.classes, model.weights)}
    side = 2 * F.col("actual") - 1
    hinge = F.greatest(F.lit(0.0), 1 - side * F.col("margin"))
    by_class = score_rows(rows, model).groupBy("class").agg(F.count("*").alias("n_rows"), F.avg(hinge).alias("loss"))
    extra = F.element_at(F.create_map(*[F.lit(x) for c in norms.items() for x in c]), F.col("class"))
    return by_class.withColumn("loss", F.col("loss") + extra)


def loss_facts(rows: DataFrame, model: LinearModel, dim: int) -> DataFrame:
    """Per class: whether the loss is below that of zero weights and of three steps."""
    three = train_hinge_descent(rows, model.classes.tolist(), dim, 3)
    steps = hinge_losses(rows, three).select("class", F.col("loss").alias("three"))
    return hinge_losses(rows, model).join(steps, "class").select(
        "class",
        "n_rows",
        (F.col("loss") < 1.0).alias("below_zero_weights"),
        (F.col("loss") <= F.col("three")).alias("below_three_steps"),
    )


@query
def svm_train(spark, sf):
    """Per class: the regularised hinge loss, below that of zero weights and of three steps."""
    rows = stored(embedding_rows(spark, sf), "rows")
    return loss_facts(rows, train_linear_svc(rows, 10, dim=EMBEDDING_WORDS), EMBEDDING_WORDS)


@query
def classifier_roundtrip(spark, sf):
    path = scratch_path(spark, "classifier")
    models.save_classifier(contrast_model(embedding_rows(spark, sf)), spark, path)
    return weight_rows(spark, models.load_classifier(spark, path))


@query
def labels_roundtrip(spark, sf):
    path = scratch_path(spark, "labels")
    models.save_labels(label_map(order_tags(spark, sf)), path)
    return models.load_labels(spark, path)


# Evaluation ---------------------------------------------------------------------------


def document_predictions(spark, sf):
    """Quality as the prediction of toxicity, per language."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    languages = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"))
    return languages.join(labels, "id").select(
        "id", "class", F.col("quality").alias("predicted"), F.col("toxic").alias("actual")
    )


@query
def confusion_documents(spark, sf):
    return confusion(document_predictions(spark, sf))


@query
def confusion_scores(spark, sf):
    return confusion(contrast_scores(spark, sf))


def rounded_ratios(report: DataFrame) -> DataFrame:
    names = [n for n, t in report.dtypes if t == "double" and n != "class"]
    return report.withColumns({n: F.round(n, 9) for n in names})


@query
def class_report_documents(spark, sf):
    return rounded_ratios(class_report(confusion_documents(spark, sf)))


@query
def class_report_scores(spark, sf):
    return rounded_ratios(class_report(confusion_scores(spark, sf)))


@query
def report_text(spark, sf):
    return report_lines(class_report(confusion_documents(spark, sf)))


@query
def report_text_scores(spark, sf):
    """With the names of the categories and the areas."""
    report = label_areas(class_report(confusion_scores(spark, sf)))
    return report_lines(report, label_map(embedding_tags(spark, sf)))


@query
def areas_by_label(spark, sf):
    return rounded_ratios(label_areas(confusion_scores(spark, sf))).select("class", "auroc", "aupr")


@query
def areas_by_margin(spark, sf):
    # Not rounded: both engines add the margins in the same order.
    return rounded_ratios(margin_areas(contrast_scores(spark, sf)))


# Whole runs ---------------------------------------------------------------------------


@query
def run_metrics(spark, sf):
    log = RunLog(spark)
    items = embedding_descriptors(spark, sf)
    tags = embedding_tags(spark, sf)
    split = prefix_split(tags, "id", 0.8)
    log.add("split", "train_entities", split.n_train)
    log.add("split", "test_entities", split.n - split.n_train)
    codebook = given_codebook(items, EMBEDDING_WORDS)
    log.add("codebook", "words", codebook.size)
    hists = histograms(log.counted(items, "descriptors"), codebook)
    stored(log.counted(hists, "histograms"), "histograms")
    return log.to_df()


def seeded_codebook(descriptors: DataFrame) -> Codebook:
    return lloyd(descriptors, given_codebook(descriptors, END_TO_END.words), END_TO_END.codebook_iterations)[0]


@query
def train_and_evaluate(spark, sf):
    fitted = fit(line_item_descriptors(spark, sf), order_tags(spark, sf), END_TO_END, seeded_codebook)
    return rounded_ratios(evaluate(fitted))


@query
def predict_from_saved(spark, sf):
    """Fit, save, load, and evaluate the test entities anew, as a second job would."""
    items, tags = line_item_descriptors(spark, sf), order_tags(spark, sf)
    fitted = fit(items, tags, END_TO_END, seeded_codebook)
    path = scratch_path(spark, "models")
    save_fitted(fitted, path)
    test = ~fitted.split.is_train("id")
    report = evaluate_on(load_fitted(spark, path), items.filter(test), tags.filter(test))
    fitted.release()
    return rounded_ratios(report)


def run_facts(fitted: Fitted) -> DataFrame:
    """Per class of a run: its test rows in the report, and what training must have reached.

    The hinge loss of the weights over the training rows is below that of zero weights and
    of three steps; the codebook has all its words, and each of them is some descriptor's.
    """
    report = evaluate(fitted)
    train = stored(fitted.rows.filter(F.col("split") == "train"), "rows")
    used = histogram_cells(fitted.rows, "id").select("word").distinct().count()
    facts = loss_facts(train, fitted.model, fitted.codebook.size).withColumnRenamed("n_rows", "n_train")
    counts = report.select(
        "class", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_test"), (F.col("tp") + F.col("fn")).alias("n_class")
    )
    return counts.join(facts, "class").withColumn("n_used_words", F.lit(used))


@query
def train_and_evaluate_kmeans(spark, sf):
    settings = Settings(words=EMBEDDING_WORDS, threshold=-0.093)
    return run_facts(fit(embedding_descriptors(spark, sf), embedding_tags(spark, sf), settings))


@query
def train_and_evaluate_default(spark, sf):
    """The default settings: 100 words in 15 iterations, 200 classifier steps."""
    return run_facts(fit(line_item_descriptors(spark, sf), order_tags(spark, sf)))


# Files --------------------------------------------------------------------------------


def written_files(rows: DataFrame, name: str, kind: str = "text") -> str:
    """Each row as a file of its own in a new folder."""
    path = scratch_path(rows.sparkSession, name)
    value = F.col("value") if kind == "text" else F.to_json(F.struct(*rows.columns))
    binary.write_entities(rows.select(value.alias("value")), path, {"text": "txt", "json": "json"}[kind])
    return path


@query
def entities_from_directory(spark, sf):
    """Pages as files, listed and read back: their sizes and contents."""
    folder = written_files(wide_table(spark, sf, "pages", "html").withColumnRenamed("html", "value"), "entities")
    listed = manifest.list_entities(spark, folder).filter("NOT hidden").select("path", "length")
    read = binary.read_entities(spark, folder, skip_hidden=True).join(listed, "path")
    return read.groupBy("length", F.md5("content").alias("digest")).agg(F.count("*").alias("n"))


@query
def metadata_from_files(spark, sf):
    """Customers as JSON files; the tag of each is read back."""
    customers = wide_table(spark, sf, "customer", "c_name", "c_mktsegment")
    tagged = customers.select("c_name", F.array("c_mktsegment", F.lit("other")).alias("tags"))
    folder = written_files(tagged, "metadata", "json")
    return read_metadata(spark, folder, skip_hidden=True).groupBy("tag").agg(F.count("*").alias("n"))


@query
def file_run(spark, sf):
    """From files to word counts: documents as files, decoded to a vector per line."""
    docs = wide_table(spark, sf, "documents", "text")
    folder = written_files(docs.withColumnRenamed("text", "value"), "files")
    items = binary.file_descriptors(spark, folder, byte_line_counts, 6, skip_hidden=True)
    counts = word_counts(assign_words(items, FILE_CODEBOOK))
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def byte_line_counts(content: bytes) -> np.ndarray:
    return line_character_counts(content.decode()[:-1])


FILE_SETTINGS = Settings(
    words=LINE_WORDS, codebook_iterations=2, classifier_iterations=3, threshold=-0.05,
    category_thresholds={"en/web": -0.06, "de/web": -0.0101},
)
FILES_PER_PART = 500


def json_line_counts(content: bytes) -> np.ndarray:
    return line_character_counts(json.loads(content)["text"])


@query
def file_report(spark, sf):
    """From a directory to the report: list, split, read tags, decode, train, evaluate, name.

    Documents become JSON files with their tag and text, whose names are in the order of the
    document ids. The categories have thresholds of their own.
    """
    docs = table(spark, sf, "documents")
    parts = docs.count() // FILES_PER_PART + 1
    both = F.array(F.concat_ws("/", "lang", "source"), F.lit("other")).alias("tags")
    rows = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select(both, "text")
    folder = written_files(rows, "report", "json")
    listed = manifest.manifest(manifest.list_entities(spark, folder).filter("NOT hidden"), "path")
    split = prefix_split(stored(listed, "listed"), "id", FILE_SETTINGS.train_fraction)
    # Opening the files takes longest: each is opened once for its tag and once for its lines.
    tags = stored(read_metadata(spark, folder, skip_hidden=True), "tags")
    items = stored(binary.file_descriptors(spark, folder, json_line_counts, 6, skip_hidden=True), "lines")

    def codebook(descriptors: DataFrame) -> Codebook:
        first = given_codebook(descriptors, FILE_SETTINGS.words)
        return lloyd(descriptors, first, FILE_SETTINGS.codebook_iterations)[0]

    fitted = fit(items, tags, FILE_SETTINGS, codebook, split)
    return report_lines(evaluate(fitted), fitted.labels)


# Given words for lines: none, and lines rich in vowels, consonants or capitals.
FILE_CODEBOOK = Codebook([[0, 0, 0, 0, 0, 0], [50, 60, 2, 0, 20, 5], [200, 250, 5, 0, 90, 10], [5, 5, 100, 0, 20, 30]])
