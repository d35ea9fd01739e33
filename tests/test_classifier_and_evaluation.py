import warnings

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from glyphist.operators import classifier as cl
from glyphist.operators import evaluate as ev
from glyphist.operators.training import class_rows, one_vs_rest
from glyphist.plans import registry
from glyphist.schema import LinearModel

ROW = "id int, label double, features array<double>"


def labelled(spark, n=120, dim=5, classes=3, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    points, labels = rng.normal(size=(n, dim)) * scale, rng.integers(0, classes, n)
    rows = [(i, float(y), p.tolist()) for i, (y, p) in enumerate(zip(labels, points))]
    return spark.createDataFrame(rows, ROW), points, labels


def descent(points, side, steps, tolerance=0.001):
    """The update rule, one class at a time."""
    w = np.zeros(points.shape[1])
    for t in range(1, steps + 1):
        active = side * (points @ w) < 1
        g = -(points * (side * active)[:, None]).sum(0) / len(points)
        new = w * (1 - 0.01 / np.sqrt(t)) - g / np.sqrt(t)
        change = np.linalg.norm(new - w)
        w = new
        if t > 1 and change < tolerance * max(np.linalg.norm(w), 1):
            break
    return w


@pytest.mark.parametrize("scale, tolerance", [(1.0, 0.001), (4.0, 0.001), (1.0, 0.1)])
def test_descent_matches_brute_force(spark, scale, tolerance):
    df, points, labels = labelled(spark, scale=scale)
    model = cl.train_hinge_descent(df, range(3), 5, 8, tolerance=tolerance)
    want = [descent(points, np.where(labels == c, 1.0, -1.0), 8, tolerance) for c in range(3)]
    assert np.allclose(model.weights, want)


def test_descent_matches_mllib(spark):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.regression import LabeledPoint

    df, points, labels = labelled(spark, scale=2.0, seed=1)
    data = spark.sparkContext.parallelize([LabeledPoint(float(y == 1), p) for y, p in zip(labels, points)], 2)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        theirs = SVMWithSGD.train(data, 10)
    ours = cl.train_hinge_descent(df, [1.0], 5, 10)
    assert np.allclose(ours.weights[0], theirs.weights.toArray())


def test_classes_beyond_one_block(spark, monkeypatch):
    df, _, _ = labelled(spark, classes=5)
    whole = cl.train_hinge_descent(df, range(5), 5, 4)
    scores = cl.score_rows(df, whole)
    want = sorted(map(tuple, scores.collect()))
    monkeypatch.setattr(cl, "CLASSES_PER_JOB", 2)
    assert np.allclose(cl.train_hinge_descent(df, range(5), 5, 4).weights, whole.weights)
    assert sorted(map(tuple, cl.score_rows(df, whole).collect())) == want


def test_linear_svc(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(3) * 4
    rows = [(i, float(i % 3), (centres[i % 3] + rng.normal(size=3) * 0.3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, ROW)
    model = cl.train_linear_svc(df.coalesce(1), 3, 5)
    best = cl.score_rows(df, model).groupBy("id").agg(F.max_by("actual", "margin").alias("hit"))
    assert best.agg(F.avg("hit")).first()[0] > 0.95


def test_tasks_of_a_linear_svc_step_follow_the_bytes(spark, monkeypatch):
    sparse, dense = sparse_and_dense(spark)
    fit, tasks = cl.OneVsRest.fit, []
    monkeypatch.setattr(cl.OneVsRest, "fit", lambda self, data: (tasks.append(data.rdd.getNumPartitions()), fit(self, data))[1])
    for limit, expected in ((cl.FIT_TASK_BYTES, 1), (-(-8 * 9 * dense.count() // 3), 3)):
        monkeypatch.setattr(cl, "FIT_TASK_BYTES", limit)
        for rows, dim in ((sparse.repartition(16), 9), (dense.repartition(16), None)):
            tasks.clear()
            model = cl.train_linear_svc(rows, 4, 3, dim=dim)
            assert tasks == [expected] and model.weights.shape == (4, 9)


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.0, [1.0]), (2, 1.0, [-1.0])], ROW)
    model = LinearModel([0.0, 1.0], [[0.5], [-0.5]]).with_threshold(0.5).with_thresholds({1.0: -0.6})
    got = {(r.id, r["class"]): (r.margin, r.predicted, r.actual) for r in cl.score_rows(df, model).collect()}
    # A margin equal to the threshold is not above it.
    assert got == {
        (1, 0.0): (0.5, 0.0, 1.0),
        (1, 1.0): (-0.5, 1.0, 0.0),
        (2, 0.0): (-0.5, 0.0, 0.0),
        (2, 1.0): (0.5, 1.0, 1.0),
    }
    assert len(cl.CATEGORY_THRESHOLDS) == 14


def test_one_vs_rest(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0)], "id int, label double")
    got = sorted(map(tuple, one_vs_rest(df, [0.0, 2.0]).select("id", "class", "y").collect()))
    assert got == [(1, 0.0, 1.0), (1, 2.0, 0.0), (2, 0.0, 0.0), (2, 2.0, 1.0)]
    assert sorted(map(tuple, class_rows(df, 2.0).select("id", "y").collect())) == [(1, 0.0), (2, 1.0)]


def predictions(spark, pairs):
    rows = [(0.0, float(p), float(a), float(p)) for p, a in pairs]
    return spark.createDataFrame(rows, "class double, predicted double, actual double, margin double")


def test_confusion_report_and_areas(spark):
    pairs = [(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)]
    counts = ev.confusion(predictions(spark, pairs))
    row = ev.label_areas(ev.class_report(counts)).first()
    assert (row.tp, row.tn, row.fp, row.fn) == (1, 2, 1, 1)
    assert (row.precision, row.recall, row.accuracy, row.fmeasure) == (0.5, 0.5, 0.6, 0.5)
    assert row.auroc == pytest.approx(0.58333, abs=1e-5) and row.aupr == pytest.approx(0.475)
    line = ev.report_lines(ev.class_report(counts)).first().line
    assert line.endswith("precision:50.00% recall:50.00% accuracy:60.00% fmeasure:0.50")
    labels = counts.sparkSession.createDataFrame([("pizza", counts.first()["class"])], "tag string, label double")
    report = ev.label_areas(ev.class_report(counts))
    line = ev.report_lines(report.withColumn("class", F.col("class").cast("double")), labels).first().line
    assert line.startswith("Category:pizza true positives: 1") and "\nArea under ROC = 0.583333" in line


def test_no_positive_prediction_gives_null_precision(spark):
    row = ev.class_report(ev.confusion(predictions(spark, [(0, 1), (0, 0)]))).first()
    assert row.precision is None and row.recall == 0.0 and row.fmeasure is None
    assert "precision:NaN%" in ev.report_lines(ev.class_report(ev.confusion(predictions(spark, [(0, 1)])))).first().line


def mllib_areas(df):
    def area(metric):
        return BinaryClassificationEvaluator(
            rawPredictionCol="margin", labelCol="actual", metricName=metric, numBins=0
        ).evaluate(df.select("margin", "actual"))

    return area("areaUnderROC"), area("areaUnderPR")


@pytest.mark.parametrize(
    "pairs",
    [
        [(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)],
        [(0, 1), (0, 0), (0, 0)],
        [(1, 1), (1, 0), (1, 0)],
        [(1, 0), (0, 0)],
        [(1, 1), (0, 1)],
        [(0, 0), (0, 0)],
    ],
)
def test_areas_match_mllib_on_labels(spark, pairs):
    df = predictions(spark, pairs)
    want = mllib_areas(df)
    by_label = ev.label_areas(ev.confusion(df)).first()
    assert (by_label.auroc, by_label.aupr) == pytest.approx(want)
    by_margin = ev.margin_areas(df).first()
    assert (by_margin.auroc, by_margin.aupr) == pytest.approx(want)


def test_margin_areas_match_mllib_per_class(spark):
    """Class 0 has a third of its rows at one margin; class 1 is much smaller."""
    rng = np.random.default_rng(6)
    rows = []
    for c, n in ((0.0, 3000), (1.0, 40)):
        actual = rng.integers(0, 2, n)
        margin = np.round(rng.normal(size=n) + actual, 2)
        margin[: n // 3] = 0.25
        rows += [(c, float(m), float(a)) for m, a in zip(margin, actual)]
    df = spark.createDataFrame(rows, "class double, margin double, actual double").repartition(4)
    got = {r["class"]: (r.auroc, r.aupr) for r in ev.margin_areas(df).collect()}
    for c in (0.0, 1.0):
        assert got[c] == pytest.approx(mllib_areas(df.filter(F.col("class") == c)))


def test_counts_add_up(spark, sf):
    scores = registry.contrast_scores(spark, sf)
    n = registry.embedding_rows(spark, sf).count()
    assert all(r.tp + r.tn + r.fp + r.fn == n for r in ev.confusion(scores).collect())


def test_vector_conversion_is_lossless(spark):
    df, points, _ = labelled(spark, n=5)
    got = df.orderBy("id").select(array_to_vector("features").alias("v")).collect()
    assert np.array_equal([r.v.toArray() for r in got], points)


def sparse_and_dense(spark, n=300, k=9, seed=4):
    """The same histograms in both forms, some of them empty."""
    rng = np.random.default_rng(seed)
    dense, sparse = [], []
    for i in range(n):
        words = np.sort(rng.choice(k, rng.integers(0, 5), replace=False))
        values = rng.random(len(words))
        row = np.zeros(k)
        row[words] = values
        dense.append((i, float(i % 4), row.tolist()))
        sparse.append((i, float(i % 4), (words.tolist(), values.tolist())))
    schema = "id int, label double, features struct<words: array<int>, freqs: array<double>>"
    return spark.createDataFrame(sparse, schema), spark.createDataFrame(dense, ROW)


def test_sparse_rows_score_and_train_as_dense_rows(spark):
    sparse, dense = sparse_and_dense(spark)
    rng = np.random.default_rng(8)
    model = LinearModel(np.arange(4.0), rng.normal(size=(4, 9)), 0.1)
    results = [sorted(map(tuple, cl.score_rows(rows, model).collect())) for rows in (sparse, dense)]
    assert results[0] == results[1]
    counts = [sorted(map(tuple, cl.confusion_of(rows, model).collect())) for rows in (sparse, dense)]
    assert counts[0] == counts[1]
    fits = [cl.train_hinge_descent(rows, range(4), 9, 12).weights for rows in (sparse, dense)]
    assert np.abs(fits[0] - fits[1]).max() < 1e-12
    svc = cl.train_linear_svc(sparse.coalesce(1), 4, 3, dim=9).weights
    assert np.abs(svc - cl.train_linear_svc(dense.coalesce(1), 4, 3).weights).max() < 1e-9
    with pytest.raises(ValueError, match="dimension"):
        cl.train_linear_svc(sparse, 4)


@pytest.mark.parametrize("top", [1, 3, 9])
def test_top_classes_are_the_best_of_all(spark, monkeypatch, top):
    """In blocks of three classes; equal margins go to the class that comes first."""
    monkeypatch.setattr(cl, "CLASSES_PER_JOB", 3)
    sparse, dense = sparse_and_dense(spark)
    weights = np.random.default_rng(9).integers(-1, 2, (7, 9)).astype(float)
    model = LinearModel(np.array([5.0, 3, 1, 0, 2, 4, 6]), weights, np.arange(7) / 20)
    place = {c: i for i, c in enumerate(model.classes.tolist())}
    by_row = {}
    for r in cl.score_rows(dense, model).collect():
        by_row.setdefault(r.id, []).append((-r.margin, place[r["class"]], r["class"], r.margin, r.predicted))
    want = sorted((i, rank, *e[2:]) for i, entries in by_row.items() for rank, e in enumerate(sorted(entries)[:top], 1))
    for rows in (sparse, dense):
        got = cl.top_scores(rows, model, top).select("id", "rank", "class", "margin", "predicted")
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        cl.top_scores(dense, model, 0)
