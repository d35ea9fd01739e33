import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphist.functions.vectors import SparseRows
from glyphist.operators import codebook as cb
from glyphist.operators import histogram as hg
from glyphist.operators.blocks import block_arrays, to_blocks
from glyphist.operators.descriptors import extracted, line_descriptors, sub_vectors
from glyphist.operators.training import training_rows
from glyphist.plans import registry
from glyphist.plans.end_to_end import histograms
from glyphist.schema import Codebook, require_uniform_dimension

DESCRIPTOR = "id string, pos int, features array<double>"


def frame(spark, points, ids=None):
    rows = [(ids[i] if ids else "e", i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, DESCRIPTOR)


def test_ties_go_to_the_lowest_word(spark):
    book = Codebook([[0.0, 0.0], [1.0, 0.0]])
    got = cb.assign_words(frame(spark, [(0.5, 0), (0.4, 0), (2, 0)]), book).orderBy("pos").collect()
    assert [r.word for r in got] == [0, 0, 1]
    assert [r.dist for r in got] == [0.25, 0.4**2, 1.0]


def test_assignment_is_narrow(spark):
    book = Codebook([[0.0, 0.0], [1.0, 0.0]])
    plan = cb.assign_words(frame(spark, [(0, 0)]), book)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("nearest_word_udf(") == 1


def test_shuffles_of_a_label_join(spark, tmp_path):
    """Two shuffles for the histograms; the join adds one, of the labels only."""
    spark.range(100).select(
        F.col("id"), F.lit(0).alias("pos"), F.array(F.col("id") * 1.0, F.lit(0.5)).alias("features")
    ).write.parquet(str(tmp_path / "points"))
    spark.range(100).select(F.col("id"), F.lit(1.0).alias("label")).write.parquet(str(tmp_path / "labels"))
    hists = histograms(spark.read.parquet(str(tmp_path / "points")), Codebook([[0.0, 0.0], [50.0, 0.0]]))
    assert shuffles(hists) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = training_rows(spark.read.parquet(str(tmp_path / "labels")), hists)
        assert shuffles(joined) == 3 and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_empty_word_keeps_its_centre_and_a_zero(spark):
    points = frame(spark, [(0.1, 0), (-0.1, 0.2)])
    book, costs = cb.lloyd(points, Codebook([[0.0, 0.0], [9.0, 9.0]]), 1)
    assert np.allclose(book.centroids, [[0.0, 0.1], [9.0, 9.0]])
    assert costs == [pytest.approx(0.06)]
    dense = hg.histogram_dense(hg.word_counts(cb.assign_words(points, book)), 2)
    assert [tuple(r) for r in dense.collect()] == [("e", [1.0, 0.0])]


def test_dense_histogram_fills_every_gap(spark):
    counts = spark.createDataFrame(
        [("a", 1, 3), ("a", 4, 1), ("b", 0, 2), ("c", 5, 7), ("d", 0, 1), ("d", 5, 1)], "id string, word int, n bigint"
    )
    got = {r.id: r.features for r in hg.histogram_dense(counts, 6).collect()}
    assert got == {
        "a": [0, 0.75, 0, 0, 0.25, 0],
        "b": [1, 0, 0, 0, 0, 0],
        "c": [0, 0, 0, 0, 0, 1],
        "d": [0.5, 0, 0, 0, 0, 0.5],
    }
    entities = spark.createDataFrame([("a",), ("z",)], "id string")
    kept = {r.id: r.features for r in hg.with_empty_entities(entities, hg.histogram_dense(counts, 6), 6).collect()}
    assert kept == {"a": got["a"], "z": [0.0] * 6}


def test_histograms_of_a_skewed_entity(spark):
    """One entity owns a third of all descriptors; counts match a plain count."""
    points = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("id"),
        F.lit(0).alias("pos"),
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"),
    )
    book = Codebook(np.random.default_rng(0).random((20, 3)))
    assigned = cb.assign_words(points, book)
    pairs = assigned.select("id", "word").collect()
    want = {}
    for r in pairs:
        want[(r.id, r.word)] = want.get((r.id, r.word), 0) + 1
    got = {(r.id, r.word): r.n for r in hg.word_counts(assigned).collect()}
    assert got == want
    sums = hg.histogram_long(hg.word_counts(assigned)).groupBy("id").agg(F.sum("freq").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums) and len(sums) == 51


def test_lloyd_cost_never_rises(spark, sf):
    points = registry.line_item_descriptors(spark, sf)
    start = registry.given_codebook(points, 12)
    book, costs = cb.lloyd(points, start, 6)
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))
    final = cb.codebook_cost(cb.assign_words(points, book)).first()
    assert final.wssse <= costs[-1] + 1e-9 and final.n_descriptors == points.count()


def test_lloyd_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    points, start = rng.normal(size=(300, 3)), rng.normal(size=(7, 3))
    centres = start.copy()
    for _ in range(4):
        word = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([points[word == i].mean(0) if (word == i).any() else centres[i] for i in range(7)])
    got, _ = cb.lloyd(frame(spark, points), Codebook(start), 4)
    assert np.allclose(got.centroids, centres)


def test_blocks_hold_all_rows(spark):
    points = np.arange(5000, dtype=float).reshape(-1, 2)
    blocks = to_blocks(frame(spark, points), 2)
    total = sum(np.frombuffer(bytes(r.points)).sum() for r in blocks.table.collect())
    blocks.release()
    assert total == points.sum()


def test_kmeans_training(spark, sf):
    points = registry.embedding_descriptors(spark, sf)
    first = cb.train_codebook(points, k=16, iterations=5, seed=3)
    again = cb.train_codebook(points, k=16, iterations=5, seed=3)
    assert first.summary.trainingCost == pytest.approx(again.summary.trainingCost)
    book = cb.codebook_of(first)
    assert (book.size, book.dim) == (16, 8)
    # MLlib reports the cost before the last step; the final centres cost no more.
    ours = cb.codebook_cost(cb.assign_words(points, book)).first().wssse
    assert 0 < ours <= first.summary.trainingCost


def test_kmeans_steps_read_blocks_and_give_a_whole_model(spark, sf, monkeypatch):
    """Spark ML, which would hold all vectors as objects, is given the centres only."""
    from pyspark.ml.clustering import KMeans

    from glyphist.operators.restarts import train_run

    fit, given = KMeans.fit, []
    monkeypatch.setattr(KMeans, "fit", lambda self, rows, *more: (given.append(rows.count()), fit(self, rows, *more))[1])
    points = registry.line_item_descriptors(spark, sf)
    model = cb.train_codebook(points, k=12, iterations=4, seed=5)
    assert given == [12] and points.count() > 12
    run = train_run(points, 12, 4, seed=5)
    assert sorted(map(tuple, model.clusterCenters())) == sorted(map(tuple, run.centres))
    assert (model.getK(), model.getMaxIter(), model.getInitMode()) == (12, 4, "k-means||")
    summary = model.summary
    assert (summary.k, summary.numIter, summary.trainingCost) == (12, run.steps, pytest.approx(run.cost))
    assert sum(summary.clusterSizes) == points.count()
    _, costs = cb.lloyd(points, Codebook(run.centres), 2)
    assert costs[1] <= costs[0] <= run.cost


def test_kmeans_with_fewer_distinct_points_than_words(spark):
    points = frame(spark, [(0, 0), (1, 1), (5, 5)] * 10)
    assert cb.codebook_of(cb.train_codebook(points, k=8)).size <= 3


def test_assignment_agrees_with_model_predictions(spark, sf):
    points = registry.line_item_descriptors(spark, sf)
    model = cb.train_codebook(points, k=10, iterations=3, init_mode="random")
    from glyphist.functions.vectors import dense_vector

    vectors = points.withColumn("arr", F.col("features")).withColumn("features", dense_vector("features"))
    predicted = model.transform(vectors).select("id", "pos", F.col("arr").alias("features"), "prediction")
    both = cb.assign_words(predicted, cb.codebook_of(model))
    assert both.filter("word != prediction").count() == 0


def test_sub_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "v bigint, e array<float>")
    got = [tuple(r) for r in sub_vectors(df, "v", "e", 2, 2).orderBy("pos").collect()]
    assert got == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]


def test_line_descriptors(spark):
    df = spark.createDataFrame([(1, "ab C9!\n\nÉe"), (2, None)], "doc_id bigint, text string")
    got = [(r.id, r.pos, r.features) for r in line_descriptors(df).orderBy("pos").collect()]
    assert got == [(1, 0, [1, 1, 1, 1, 1, 1]), (1, 1, [0] * 6), (1, 2, [1, 0, 0, 0, 0, 1])]


def test_user_function_may_return_nothing_and_must_keep_the_dimension(spark):
    df = spark.createDataFrame([("a", "1 2"), ("b", ""), ("c", "3")], "id string, payload string")

    def numbers(text):
        return np.array([[float(v), 0.0] for v in text.split()])

    got = sorted((r.id, r.pos, r.features) for r in extracted(df, "id", "payload", numbers, 2).collect())
    assert got == [("a", 0, [1.0, 0.0]), ("a", 1, [2.0, 0.0]), ("c", 0, [3.0, 0.0])]
    with pytest.raises(Exception, match="expected"):
        extracted(df, "id", "payload", numbers, 3).collect()


def test_dimension_check(spark):
    assert require_uniform_dimension(frame(spark, [(1, 2), (3, 4)])) == 2
    with pytest.raises(ValueError, match="differ"):
        require_uniform_dimension(frame(spark, [(1, 2), (3,)]))


@pytest.mark.parametrize("step_bytes", [1 << 20, 3 * 2 * 8 * 19, 3 * 2 * 8 * 4, 0])
def test_sums_by_the_driver_by_groups_and_by_keys(spark, monkeypatch, step_bytes):
    """The same totals whichever way the matrices of the tasks are added up; the cores do not matter."""
    from glyphist.operators.blocks import Blocks, summed_partials

    points = np.arange(4000, dtype=float).reshape(-1, 2)
    written = to_blocks(frame(spark, points).repartition(20), 2)
    blocks = Blocks(written.table.repartition(20), 20)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 1 / 0))

    def sums(batches):
        total = np.zeros((3, 2))
        for batch in batches:
            for value in batch.column("points"):
                own = np.frombuffer(value.as_buffer()).reshape(-1, 2)
                total[1] += own.sum(axis=0)
                total[2] += len(own)
        return total

    got = summed_partials(blocks, sums, 3, 2, step_bytes)
    assert np.array_equal(got, [[0, 0], points.sum(axis=0), [2000, 2000]])
    written.release()


def sparse(spark, rows, schema="id int, features struct<words: array<int>, freqs: array<double>>"):
    return spark.createDataFrame(rows, schema)


def test_sparse_histograms_hold_the_words_that_occur(spark):
    counts = spark.createDataFrame([(1, 5, 2), (1, 0, 1), (2, 3, 4)], "id int, word int, n bigint")
    rows = hg.histogram_sparse(counts)
    got = {r.id: (r.features.words, r.features.freqs) for r in rows.collect()}
    assert got == {1: ([0, 5], [1 / 3, 2 / 3]), 2: ([3], [1.0])}
    dense = {r.id: r.features for r in hg.dense_rows(rows, 6).collect()}
    assert dense == {1: [1 / 3, 0, 0, 0, 0, 2 / 3], 2: [0, 0, 0, 1.0, 0, 0]}
    entities = spark.createDataFrame([(1,), (3,)], "id int")
    kept = hg.with_empty_entities(entities, rows, 6)
    assert {r.id: r.features.words for r in kept.collect()} == {1: [0, 5], 3: []}
    assert {r.id: r.features for r in hg.dense_rows(kept, 2).filter("id = 3").collect()} == {3: [0.0, 0.0]}
    assert sorted(map(tuple, hg.histogram_cells(rows, "id").collect())) == [(1, 0, 1 / 3), (1, 5, 2 / 3), (2, 3, 1.0)]


def test_sparse_bytes_follow_the_words_and_not_the_codebook(spark):
    """A stored row is as large with a million words as with six; no plan step makes it dense."""
    counts = spark.range(200).selectExpr("id", "CAST(id % 6 AS INT) AS word", "1L AS n")
    far = counts.withColumn("word", F.col("word") + 999_000)
    sizes = []
    for part, dim in ((counts, 6), (far, 1_000_000)):
        rows = hg.histogram_sparse(part)
        assert "array_repeat" not in rows._jdf.queryExecution().toString()
        blocks = to_blocks(rows, dim)
        sizes.append(sum(len(r.words) + len(r.freqs) + len(r.sizes) for r in blocks.table.collect()))
        blocks.release()
    assert sizes == [200 * 16, 200 * 16]


def test_large_sparse_blocks_are_short_and_exact(spark):
    """An entry takes some bytes and not twelve where words and frequencies are few, and all numbers come back."""
    rng = np.random.default_rng(5)
    for values in (np.arange(1, 8) / 7, rng.random(20_000)):
        rows = []
        for i in range(3_000):
            words = sorted(rng.choice(100, i % 7, replace=False).tolist())
            rows.append((i, float(i % 5), (words, rng.choice(values, len(words)).tolist())))
        schema = "id long, label double, features struct<words: array<int>, freqs: array<double>>"
        blocks = to_blocks(spark.createDataFrame(rows, schema).coalesce(1), 100, "label")
        got, size = [], 0
        for batch in blocks.table.toArrow().to_batches():
            size += sum(len(x.as_buffer()) for name in ("sizes", "words", "freqs") for x in batch.column(name))
            for labels, part in block_arrays(batch, 100):
                for i, label in enumerate(labels.tolist()):
                    own = part[i : i + 1]
                    got.append((label, own.words.tolist(), own.values.tolist()))
        blocks.release()
        assert sorted(got) == sorted((label, *features) for _, label, features in rows)
        if len(values) == 7:
            assert size < 4 * sum(len(w) for _, _, (w, _) in rows)


def test_signed_sums_are_weighted_sums():
    rng = np.random.default_rng(6)
    sizes = rng.integers(0, 5, 4_000)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = SparseRows(at, rng.integers(0, 30, at[-1]), rng.random(at[-1]))
    for n_classes in (1, 2, 4, 6, 12):
        signs = rng.integers(-1, 2, (4_000, n_classes)).astype(float)
        assert np.allclose(rows.signed_sums(signs, 30), rows.weighted_sums(signs, 30), rtol=1e-12, atol=1e-9)
    assert not SparseRows(np.zeros(4, int), np.zeros(0, int), np.zeros(0)).signed_sums(np.ones((3, 2)), 30).any()


@pytest.mark.parametrize("words, freqs", [([1, 0], [0.5, 0.5]), ([0, 7], [0.5, 0.5]), ([0], [0.5, 0.5]), ([0], [float("nan")]), ([0, None], [0.1, 0.2]), ([-1], [1.0])])
def test_rows_that_are_no_sparse_rows_are_an_error(spark, words, freqs):
    with pytest.raises(Exception, match="feature vector"):
        to_blocks(sparse(spark, [(1, ([2], [1.0])), (2, (words, freqs))]), 7)
    with pytest.raises(Exception, match="feature vector"):
        to_blocks(sparse(spark, [(1, None)]), 7)


def test_index_gives_the_direct_sum(spark):
    from glyphist.functions.vectors import WordIndex, nearest

    rng = np.random.default_rng(5)
    for dim, k in ((1, 40), (2, 500), (6, 3000)):
        # Grid values: many equal distances, so ties decide; some words are the same.
        words = rng.integers(-4, 5, (k, dim)).astype(float)
        points = np.vstack([rng.integers(-9, 9, (700, dim)) / 2, rng.normal(size=(300, dim)) * 1e6, np.zeros((1, dim))])
        index = WordIndex(words)
        for got, want in zip(index.nearest(points), nearest(points, words)):
            assert np.array_equal(got, want)
    same = WordIndex(np.ones((50, 3)))
    assert same.nearest(np.zeros((4, 3)))[0].tolist() == [0] * 4 and len(same.nearest(np.zeros((0, 3)))[0]) == 0


def test_index_looks_at_few_words():
    from glyphist.functions import vectors

    rng = np.random.default_rng(6)
    words, points = rng.random((20_000, 4)), rng.random((500, 4))
    index, seen = vectors.WordIndex(words), []
    compare = index._compare
    index._compare = lambda p, rows, cell, *rest: (seen.append(len(rows) * (index._begin[cell + 1] - index._begin[cell])), compare(p, rows, cell, *rest))
    index.nearest(points)
    assert sum(seen) < 0.1 * len(words) * len(points)


def test_large_codebooks_go_through_the_index(spark, monkeypatch):
    from glyphist.functions import vectors

    rng = np.random.default_rng(7)
    points, book = frame(spark, rng.normal(size=(300, 3))), Codebook(rng.normal(size=(90, 3)))
    want = sorted(map(tuple, cb.assign_words(points, book).collect()))
    monkeypatch.setattr(vectors, "INDEX_WORDS", 50)
    assert sorted(map(tuple, cb.assign_words(points, book).collect())) == want


def test_restarts_share_passes_and_do_not_change_each_other(spark, sf):
    from glyphist.operators import restarts

    points = registry.embedding_descriptors(spark, sf)
    for mode in ("k-means||", "random"):
        many = restarts.train_restarts(points, 16, 5, 3, mode, seed=3)
        alone = [restarts.train_restarts(points, 16, 5, 1, mode, seed=3 + r).cost for r in range(3)]
        assert many.costs == pytest.approx(alone, rel=1e-9) and len(set(many.costs)) == 3
        ours = cb.codebook_cost(cb.assign_words(points, many.codebook)).first().wssse
        assert ours == pytest.approx(min(many.costs)) and many.codebook.size == 16
        given = cb.first_descriptors(points, 16, "id", "pos", "features")
        assert many.cost < cb.codebook_cost(cb.assign_words(points, given)).first().wssse
    spark_ml = cb.train_codebook(points, 16, 5, seed=3).summary.trainingCost
    assert restarts.train_restarts(points, 16, 5, seed=3).cost < 1.1 * spark_ml
    for wrong in ({"runs": 0}, {"init_mode": "x"}):
        with pytest.raises(ValueError):
            restarts.train_restarts(points, **wrong)


def test_passes_do_not_grow_with_the_runs(spark, sf, monkeypatch):
    from glyphist.operators import restarts

    points, passes = registry.embedding_descriptors(spark, sf), []
    counted = restarts.summed_partials
    monkeypatch.setattr(restarts, "summed_partials", lambda *a: (passes.append(1), counted(*a))[1])
    numbers = []
    for runs in (1, 4):
        passes.clear()
        restarts.train_restarts(points, 8, 4, runs, tolerance=0.0)
        numbers.append(len(passes))
    assert numbers[0] == numbers[1]


def test_restarts_with_fewer_distinct_points_than_words(spark):
    from glyphist.operators.restarts import train_restarts

    points = frame(spark, [(0, 0), (1, 1), (5, 5)] * 10)
    for mode in ("k-means||", "random"):
        found = train_restarts(points, 8, 3, 2, mode)
        assert found.codebook.size <= 3
    assert train_restarts(points, 8, 3, 2).cost == 0.0
    with pytest.raises(ValueError, match="no descriptors"):
        train_restarts(points.limit(0), 2)


def test_words_of_a_table_in_blocks(spark):
    rng = np.random.default_rng(3)
    points, book = frame(spark, rng.normal(size=(200, 3))), Codebook(rng.normal(size=(11, 3)))
    want = {(r.id, r.pos): (r.word, r.dist) for r in cb.assign_words(points, book).collect()}
    plan = cb.assign_words_of_table(points, book.to_df(spark))._jdf.queryExecution().toString()
    assert "array(" not in plan
    got = cb.assign_words_of_table(points, book.to_df(spark), max_bytes=4 * 24)
    assert {(r.id, r.pos): (r.word, r.dist) for r in got.collect()} == want
