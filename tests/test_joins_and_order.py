import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphist.operators.joins import hot_keys, is_small, join_on_entity, lookup_join
from glyphist.operators.labels import distinct_tags, label_drops, label_entities, label_for_tag, label_map
from glyphist.operators.ordering import with_rank
from glyphist.operators.split import HashSplit, prefix_split
from glyphist.operators.training import training_rows


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_lookup_join_broadcast_and_salted_agree(spark, max_rows):
    # One key holds most rows; one key is unknown.
    df = spark.range(500).select("id", F.when(F.col("id") < 400, "a").when(F.col("id") < 450, "b").otherwise("z").alias("t"))
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "t string, v int")
    joined = lookup_join(df, table, "t", max_rows=max_rows, salts=4)
    counts = {r.v: r["count"] for r in joined.groupBy("v").count().collect()}
    assert counts == {1: 400, 2: 50, None: 50}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (max_rows > 0)


def test_is_small_checks_rows_and_bytes(spark):
    df = spark.range(10).select(F.lit("x" * 100).alias("s"))
    assert is_small(df, 10) and not is_small(df, 9) and not is_small(df, 10, max_bytes=500)


def skewed(spark):
    """Key 7 holds a third of the rows."""
    return spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("id"), F.col("id").alias("n"))


def test_hot_keys_are_found(spark):
    assert hot_keys(skewed(spark), "id", min_rows=50, share=0.1) == [7]
    assert hot_keys(skewed(spark), "id") == []


@pytest.mark.parametrize("min_rows", [50, 10**6])
def test_join_on_entity_keeps_all_rows(spark, min_rows):
    many = skewed(spark)
    one = spark.range(0, 200).select("id", (F.col("id") * 2).alias("twice"))
    got = rows(join_on_entity(many, one, "id", min_rows, 0.1), "id", "n", "twice")
    assert got == rows(many.join(one, "id"), "id", "n", "twice")
    assert len(got) == 200


def test_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("key"))
    got = with_rank(df, "key").filter("key != rank").count()
    assert got == 0


@pytest.mark.parametrize("n, fraction", [(10, 0.8), (7, 0.5), (3, 0.0), (5, 1.0), (1, 0.8), (1001, 0.29)])
def test_prefix_split(spark, n, fraction):
    df = spark.range(n).select(F.format_string("k%05d", (F.col("id") * 7919) % n).alias("key"))
    split = prefix_split(df, "key", fraction)
    got = split.apply(df, "key")
    train = sorted(r.key for r in got.filter("split = 'train'").collect())
    assert got.count() == n == split.n
    assert train == sorted(r.key for r in df.collect())[: int(n * fraction)]


def test_prefix_split_keeps_equal_keys_together(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "key int")
    for fraction, n_train in ((0.0, 0), (0.2, 1), (0.4, 3), (0.6, 3), (0.8, 4), (1.0, 4)):
        split = prefix_split(df, "key", fraction)
        assert (split.n, split.n_train) == (5, n_train)
        assert split.apply(df, "key").filter("split = 'train'").count() == n_train
    assert prefix_split(df.filter("key IS NULL"), "key", 0.5).n_train == 0


@pytest.mark.parametrize("kind", ["long", "string", "date", "double"])
def test_key_at_rank_in_several_rounds(spark, monkeypatch, kind):
    """With small limits; one key holds a third of the rows, others repeat."""
    from glyphist.operators import split as sp

    monkeypatch.setattr(sp, "SAMPLE_KEYS", 60)
    monkeypatch.setattr(sp, "BRACKET_KEYS", 25)
    number = F.when(F.col("id") % 3 == 0, 400).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)))
    of = {
        "long": number.cast("long"),
        "string": F.concat(F.lit("k/é"), number.cast("string")),
        "date": F.date_add(F.lit("2001-01-01").cast("date"), number.cast("int")),
        "double": number / 7,
    }
    df = spark.range(3000).select(of[kind].alias("key")).unionByName(spark.range(40).select(F.lit(None).cast(kind).alias("key")))
    keys = sorted(r.key for r in df.filter("key IS NOT NULL").collect())
    for fraction in (0.0005, 0.1, 0.3, 0.45, 0.6, 0.97, 0.995):
        split = prefix_split(df, "key", fraction)
        asked = min(int(3040 * fraction), 3000)
        assert split.last_key == keys[asked - 1]
        assert (split.n, split.n_train) == (3040, sum(k <= keys[asked - 1] for k in keys))


def test_key_at_rank_with_few_different_keys(spark, monkeypatch):
    from glyphist.operators import split as sp

    monkeypatch.setattr(sp, "SAMPLE_KEYS", 50)
    monkeypatch.setattr(sp, "BRACKET_KEYS", 10)
    df = spark.range(2000).select((F.col("id") % 2).alias("key"))
    assert [prefix_split(df, "key", f).n_train for f in (0.3, 0.5, 0.51)] == [1000, 1000, 2000]


def test_split_sorts_no_keys(spark, sf, monkeypatch):
    """Whatever is exchanged has one row a task."""
    from glyphist.operators import split as sp

    monkeypatch.setattr(sp, "BRACKET_KEYS", 100)
    plans = []
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda self: (plans.append(self._jdf.queryExecution().toString()), first(self))[1])
    tags = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    prefix_split(tags, "o_orderkey", 0.8)
    assert len(plans) > 3 and not any("rangepartitioning" in p or "hashpartitioning" in p for p in plans)


def test_hash_split_is_a_fixed_partition(spark):
    df = HashSplit(0.8).apply(spark.range(20_000), "id")
    share = df.filter("split = 'train'").count() / 20_000
    assert abs(share - 0.8) < 0.02
    assert df.filter(HashSplit(0.8).is_train("id") != (F.col("split") == "train")).count() == 0


def test_labels(spark):
    tags = spark.createDataFrame(
        [(1, "pear"), (2, "apple"), (3, None), (4, "pear"), (5, "plum")], "id int, tag string"
    )
    assert rows(distinct_tags(tags), "tag") == [("apple",), ("pear",), ("plum",)]
    labels = label_map(tags.filter("id < 5"))
    assert rows(labels, "tag", "label") == [("apple", 0.0), ("pear", 1.0)]
    assert label_for_tag(labels, "pear") == 1.0 and label_for_tag(labels, "fig") is None
    labelled = label_entities(tags, labels)
    assert rows(labelled, "id", "label") == [(1, 1.0), (2, 0.0), (3, None), (4, 1.0), (5, None)]
    assert label_drops(labelled).first().asDict() == {"n_no_tag": 1, "n_unknown_tag": 1, "n_labelled": 3}


def test_training_rows_join(spark):
    """One-sided ids vanish, repeated labels repeat the row, unlabelled ids are dropped."""
    labelled = spark.createDataFrame(
        [(1, "a", 0.0), (1, "b", 1.0), (2, "x", None), (9, "a", 0.0)], "id int, tag string, label double"
    )
    hists = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id int, features array<double>")
    assert rows(training_rows(labelled, hists), "id", "label") == [(1, 0.0), (1, 1.0)]


def test_entities_are_computed_once_for_hot_keys(spark, tmp_path):
    """With a count on the way and a decoder of the user, one scan and one pass remain."""
    from glyphist.operators.descriptors import extracted
    from glyphist.operators.histogram import histogram_dense, word_counts
    from glyphist.operators.codebook import assign_words
    from glyphist.schema import Codebook
    from glyphist.sources.run_log import RunLog

    calls = spark.sparkContext.accumulator(0)

    def decode(payload):
        calls.add(1)
        return np.array([[float(len(payload))]])

    skewed(spark).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    payloads = spark.range(200).select("id", F.lit("x").alias("payload"))
    log = RunLog(spark)
    items = log.counted(extracted(payloads, "id", "payload", decode, 1), "descriptors")
    one = histogram_dense(word_counts(assign_words(items, Codebook([[0.0], [1.0]]))), 2)
    joined = join_on_entity(many, one, "id", 50, 0.1)
    assert joined.count() == many.filter("id < 200").count() and calls.value == 200
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" in plan
    assert {m: v for _, m, v in log.collect()}["rows"] == 200


def test_large_rows_of_hot_keys_are_not_broadcast(spark, monkeypatch):
    from glyphist.operators import joins

    monkeypatch.setattr(joins.is_small, "__defaults__", (joins.BROADCAST_MAX_ROWS, 10))
    many, one = skewed(spark), spark.range(200).withColumn("m", F.lit(1))
    assert join_on_entity(many, one, "id", 50, 0.1).count() == many.filter("id < 200").count()



def test_tables_by_entity_join_without_an_exchange(spark):
    from glyphist.operators.tables import release_by_entity, store_by_entity

    one = spark.range(300).select(F.when(F.col("id") < 299, F.col("id")).alias("id"), (F.col("id") * 2).alias("twice"))
    many = spark.range(900).select((F.col("id") % 350).alias("id"), F.col("id").alias("n")).unionByName(
        spark.range(3).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("n"))
    )
    want = rows(many.join(one, "id"), "id", "n", "twice")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = store_by_entity(many, 7), store_by_entity(one, 7)
        assert left.filter("id IS NULL").count() == 0 and right.count() == 299
        for _ in range(2):
            joined = left.join(right, "id")
            assert rows(joined, "id", "n", "twice") == want
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
        grouped = left.groupBy("id").count()
        assert grouped.count() == 350 and "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        assert len(right.inputFiles()) <= 7
        files = right.inputFiles()
        release_by_entity(left, right, one)
        assert not any(__import__("os").path.exists(f.replace("file:", "").replace("//", "")) for f in files)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        store_by_entity(one, 0)


def test_training_rows_of_tables_by_entity_move_no_rows(spark, sf):
    from glyphist.operators.tables import store_by_entity
    from glyphist.plans import registry

    items, tags = registry.line_item_descriptors(spark, sf), registry.order_tags(spark, sf)
    hists = store_by_entity(registry.histograms(items, registry.given_codebook(items, 4)), 5)
    labels = store_by_entity(registry.label_entities(tags, registry.label_map(tags)), 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = training_rows(labels, hists)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
