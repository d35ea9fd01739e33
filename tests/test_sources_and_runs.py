import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphist.operators.codebook import assign_words
from glyphist.operators.split import HashSplit, prefix_split
from glyphist.plans import registry
from glyphist.plans.end_to_end import (
    Settings,
    evaluate,
    evaluate_on,
    fit,
    load_fitted,
    predict,
    save_fitted,
    thresholds_by_label,
)
from glyphist.schema import Codebook, LinearModel
from glyphist.session import shared_dir, spread
from glyphist.sources import binary, libsvm, manifest, models
from glyphist.sources.metadata import read_metadata
from glyphist.sources.run_log import RunLog


def test_directory_manifest_and_path_lists(spark, tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    for name in ("c.jpg", "a.jpg", "b.png", "d.JPG", "e.jpg"):
        (images / name).write_bytes(b"x")
    listed = manifest.list_entities(spark, str(images))
    table = manifest.manifest(listed, "path", "metadata/")
    split = prefix_split(table, "path", 0.8).apply(table, "path")
    got = sorted((r.id, r.meta_path, r.split) for r in split.collect())
    assert got == [
        ("a", "metadata/a.json", "train"),
        ("b", "metadata/b.png", "train"),
        ("c", "metadata/c.json", "train"),
        ("d", "metadata/d.JPG", "train"),
        ("e", "metadata/e.json", "test"),
    ]
    target = str(tmp_path / "lists")
    manifest.write_path_lists(split, target)
    train = manifest.read_path_list(spark, target, "train", "metadata")
    assert sorted(r.path for r in train.collect()) == sorted(m for _, m, s in got if s == "train")
    assert manifest.read_path_list(spark, target, "test", "entity").count() == 1


def test_listing_has_every_name(spark, tmp_path):
    for name in ("a.jpg", "_b.jpg", ".c.jpg", "x y%20.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "d.jpg").write_bytes(b"")
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "z.jpg").write_bytes(b"z")
    rows = manifest.list_entities(spark, str(tmp_path)).collect()
    names = {r.path.rsplit("/", 1)[1]: (r.length, r.hidden) for r in rows}
    assert names == {
        "a.jpg": (1, False), "_b.jpg": (1, True), ".c.jpg": (1, True), "d.jpg": (0, False), "x y%20.png": (1, False),
    }
    with pytest.raises(ValueError, match="2 hidden"):
        binary.read_entities(spark, str(tmp_path))
    read = {r.id: bytes(r.content) for r in binary.read_entities(spark, str(tmp_path), skip_hidden=True).collect()}
    assert read == {"a": b"x", "d": b"", "x y%20": b"x"}


def test_listing_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "NAMES_PER_PIECE", 3)
    for i in range(8):
        (tmp_path / f"{i}.jpg").write_bytes(b"")
    (tmp_path / "x.jpg").write_bytes(b"x")
    rows = manifest.list_entities(spark, str(tmp_path)).collect()
    assert sorted(r.length for r in rows) == [0] * 8 + [1]


def test_names_of_ordinary_files_are_not_looked_at_one_by_one(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    monkeypatch.setattr(manifest, "scratch_path", None)
    assert manifest.list_entities(spark, str(tmp_path)).count() == 5


def files_read(df) -> int:
    """Files that the scan of an executed plan opened."""
    import re

    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Join" not in plan.toString()
    stack, total = [plan], 0
    while stack:
        node = stack.pop()
        if re.match(r"Scan binaryFile|FileScan binaryFile", node.nodeName()) or "binaryFile" in node.nodeName():
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
    return total


def test_payloads_are_read_without_a_join_and_nested_files_not_at_all(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.png"):
        (tmp_path / name).write_bytes(b"x" * 100)
    for folder in ("k=1", "k=2/deep", "plain"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "z.jpg").write_bytes(b"z" * 100)
    (tmp_path / "e.jpg").write_bytes(b"")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        everything = manifest.read_files(spark, str(tmp_path))
        assert sorted(r.path.rsplit("/", 1)[1] for r in everything.collect()) == ["a.jpg", "b.jpg", "c.png", "e.jpg"]
        assert files_read(manifest.read_files(spark, str(tmp_path))) == 3
        assert files_read(manifest.read_files(spark, str(tmp_path) + "/", "*.jpg")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_have_two_marks_only(spark, tmp_path):
    for name in ("a[1].jpg", "a1.jpg", "{b}.jpg", "b.jpg"):
        (tmp_path / name).write_bytes(b"x")
    for glob, names in (("a[1].*", ["a[1]"]), ("{?}.jpg", ["{b}"]), ("?1.jpg", ["a1"]), ("*", ["a1", "a[1]", "b", "{b}"])):
        assert sorted(r.id for r in binary.read_entities(spark, str(tmp_path), glob).collect()) == names


def test_one_metadata_file_is_one_row(spark, tmp_path):
    (tmp_path / "two.json").write_text('[{"tags": ["a"]}, {"tags": ["b"]}]')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "z.json").write_text('{"tags": ["z"]}')
    (tmp_path / "one.json").write_text('{"tags": ["t"]}')
    got = sorted((r.id, r.tag) for r in read_metadata(spark, str(tmp_path)).collect())
    assert got == [("empty", None), ("one", "t"), ("two", None)]


def test_metadata_files(spark, tmp_path):
    texts = {
        "one": json.dumps({"tags": ["pizza", "dinner"]}, indent=2),
        "none": '{"tags": []}',
        "missing": "{}",
        "text": '{"tags": "x"}',
        "bad": "not json",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.id: r.tag for r in read_metadata(spark, str(tmp_path)).collect()}
    assert got == {"one": "pizza", "none": None, "missing": None, "text": None, "bad": None}


def test_ids_agree_for_unusual_file_names(spark, tmp_path):
    names = ["a b", "p+q", "x%20y", "é ü", "v1.2"]
    for name in names:
        (tmp_path / f"{name}.json").write_text('{"tags": ["t"]}')
    assert sorted(r.id for r in read_metadata(spark, str(tmp_path)).collect()) == sorted(names)
    assert sorted(r.id for r in binary.read_entities(spark, str(tmp_path)).collect()) == sorted(names)


def test_binary_entities_with_equal_base_names_merge(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(bytes([1, 2, 3, 4]))
    (tmp_path / "x.png").write_bytes(bytes([5, 6]))
    (tmp_path / "y.jpg").write_bytes(bytes([7, 8]))
    (tmp_path / "empty.jpg").write_bytes(b"")

    def pairs(content):
        return np.frombuffer(content, dtype=np.uint8).reshape(-1, 2)

    got = sorted((r.id, r.features) for r in binary.file_descriptors(spark, str(tmp_path), pairs, 2).collect())
    assert got == [("x", [1.0, 2.0]), ("x", [3.0, 4.0]), ("x", [5.0, 6.0]), ("y", [7.0, 8.0])]
    only = binary.read_entities(spark, str(tmp_path), "*.jpg").select("id").collect()
    assert sorted(r.id for r in only) == ["empty", "x", "y"]


def test_models_survive_saving_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "m")
    for scale in (1.0, 2.0):
        models.save_codebook(Codebook(np.arange(6.0).reshape(3, 2) * scale), spark, path)
    assert np.array_equal(models.load_codebook(spark, path).centroids, np.arange(6.0).reshape(3, 2) * 2)
    model = LinearModel([1.0, 0.0], [[1.0, 2.0], [3.0, 4.0]], [0.5, -0.5])
    models.save_classifier(model, spark, str(tmp_path / "c"))
    back = models.load_classifier(spark, str(tmp_path / "c"))
    assert back.classes.tolist() == [0.0, 1.0] and back.thresholds.tolist() == [-0.5, 0.5]
    assert back.weights.tolist() == [[3.0, 4.0], [1.0, 2.0]]
    labels = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "tag string, label double")
    models.save_labels(labels, str(tmp_path / "l"))
    assert sorted(map(tuple, models.load_labels(spark, str(tmp_path / "l")).collect())) == [("a", 0.0), ("b", 1.0)]


def test_kmeans_model_roundtrip(spark, sf, tmp_path):
    from glyphist.operators.codebook import codebook_of, train_codebook

    model = train_codebook(registry.embedding_descriptors(spark, sf), k=4, iterations=2)
    models.save_kmeans(model, str(tmp_path / "k"))
    assert np.array_equal(codebook_of(models.load_kmeans(str(tmp_path / "k"))).centroids, codebook_of(model).centroids)


def test_oversized_model_is_refused(spark):
    book = Codebook(np.zeros((10, 2)))
    with pytest.raises(ValueError, match="limit"):
        Codebook.from_df(book.to_df(spark), max_bytes=100)
    assert Codebook.from_df(book.to_df(spark), max_bytes=160).size == 10


def test_libsvm_files(spark, tmp_path):
    rows = spark.createDataFrame([(3.0, [0.0, 0.5, 0.0])], "label double, features array<double>")
    libsvm.write_libsvm(rows, str(tmp_path / "full"))
    assert [r.value for r in spark.read.text(str(tmp_path / "full")).collect()] == ["3.0 1:0.0 2:0.5 3:0.0"]
    libsvm.write_libsvm_lines(rows, str(tmp_path / "lines"))
    got = [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert got == ["3.0 1:0.00000 2:0.50000 3:0.00000 "]


def test_run_log(spark, tmp_path):
    log = RunLog(spark)
    with log.timed("stage"):
        log.counted(spark.range(7), "read", odd=F.count_if(F.col("id") % 2 == 1)).count()
    log.append_to(str(tmp_path / "log"))
    log.append_to(str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log"))
    assert rows.filter("metric = 'rows'").select("value").distinct().first().value == 7.0
    assert rows.filter("metric = 'odd'").first().value == 3.0
    assert rows.count() == 6


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    else:
        assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_spread_only_if_needed(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide) is wide


def test_row_wise_operators_accept_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, [0.1]), ("b", 0, [0.9])], "id string, pos int, features array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    words = assign_words(stream, Codebook([[0.0], [1.0]]))
    query = words.writeStream.format("memory").queryName("words").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    assert sorted((r.id, r.word) for r in spark.table("words").collect()) == [("a", 0), ("b", 1)]


@pytest.mark.parametrize("split", [None, HashSplit(0.7)])
def test_whole_run(spark, sf, split):
    settings = Settings(words=8, codebook_iterations=2, classifier_iterations=2, threshold=-0.1, store_descriptors=True)
    items, tags = registry.line_item_descriptors(spark, sf), registry.order_tags(spark, sf)
    fitted = fit(items, tags, settings, split=split)
    report = evaluate(fitted).collect()
    test_rows = fitted.rows.filter("split = 'test'").count()
    assert len(report) == fitted.labels.count()
    assert all(r.tp + r.tn + r.fp + r.fn == test_rows for r in report)
    log = {(s, m): v for s, m, v in fitted.log.collect()}
    assert log[("descriptors", "rows")] == items.count()
    assert log[("rows", "rows")] == fitted.rows.count()
    assert log[("codebook", "words")] == 8
    # Training and test entities are disjoint and every histogram sums to 1.
    assert fitted.rows.groupBy("id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    sums = fitted.rows.select(F.aggregate("features.freqs", F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0


def test_thresholds_by_label(spark):
    labels = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "tag string, label double")
    assert thresholds_by_label(labels, {"b": 0.5, "zz": 1.0}) == {1.0: 0.5}
    assert thresholds_by_label(labels, {}) == {}


def test_saved_models_classify_new_entities(spark, sf, tmp_path):
    settings = Settings(words=8, codebook_iterations=2, classifier_iterations=3, threshold=-0.1)
    items, tags = registry.line_item_descriptors(spark, sf), registry.order_tags(spark, sf)
    fitted = fit(items, tags, settings)
    save_fitted(fitted, str(tmp_path / "m"))
    loaded = load_fitted(spark, str(tmp_path / "m"))
    test = ~fitted.split.is_train("id")
    again = evaluate_on(loaded, items.filter(test), tags.filter(test))
    counts = ("class", "tp", "tn", "fp", "fn")
    assert sorted(map(tuple, again.select(*counts).collect())) == sorted(map(tuple, evaluate(fitted).select(*counts).collect()))
    predicted = predict(loaded, items.filter(test))
    assert {r.tag for r in predicted.select("tag").distinct().collect()} == {r.tag for r in fitted.labels.collect()}
    log = {(stage, metric): v for stage, metric, v in fitted.log.collect()}
    assert log[("settings", "classifier_iterations")] == 3
    fitted.release()


def test_many_rows_become_files_in_their_order(spark, tmp_path):
    rows = spark.range(1500).coalesce(1).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("value"))
    binary.write_entities(rows, str(tmp_path / "files"), "txt")
    names = sorted(p.name for p in (tmp_path / "files").iterdir())
    contents = [(tmp_path / "files" / n).read_text() for n in names]
    assert contents == ["\n" if i == 7 else f"{i}\n" for i in range(1500)]
    assert not list((tmp_path / "files.tmp").iterdir())
    with pytest.raises(FileExistsError):
        binary.write_entities(rows, (tmp_path / "files").as_uri(), "txt")


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    few = manifest.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for i in range(32 * few + 100):
        (tmp_path / f"{i}.txt").write_text(str(i))
    for found in (manifest.read_files(spark, str(tmp_path)), manifest.list_entities(spark, str(tmp_path))):
        assert found.rdd.getNumPartitions() <= few + spark.sparkContext.defaultParallelism
        assert found.select("path").distinct().count() == 32 * few + 100


def test_folders_of_many_files_are_listed_and_read_without_spark_s_list(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%20c"
    (folder / "k=1" / "deep").mkdir(parents=True)
    contents = {"a b.txt": b"1", "p+q.txt": b"22\n", "x%20y.txt": b"", "\u00e9 \u00fc.bin": bytes(range(256)), "a[1]{b}.txt": b"5" * 100}
    contents |= {f"{i}.txt": str(i).encode() for i in range(20)} | {"_h.txt": b"h", ".i.txt": b"", ".a.txt.crc": b"sum"}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    for nested in ("k=1", "k=1/deep"):
        (folder / nested / "z.txt").write_bytes(b"z")
    (folder / "link.txt").symlink_to(folder / "3.txt")
    (folder / "broken.txt").symlink_to(folder / "none")
    plain, uri = str(folder), folder.as_uri().replace("%20", " ").replace("%25", "%") + "/"
    by_spark = None
    for at, limit, piece, batch in ((plain, 1000, 1000, 1000), (plain, 5, 1000, 1000), (uri, 5, 7, 30)):
        for name, value in (("INDEXED_FILES", limit), ("BATCH_FILES", piece), ("BATCH_BYTES", batch)):
            monkeypatch.setattr(manifest, name, value)
        frames = [manifest.list_entities(spark, at), manifest.read_files(spark, at, skip_hidden=True)]
        frames.append(manifest.read_files(spark, at, "a[1]*", True))
        if limit < 1000:
            assert not any("binaryFile" in f._jdf.queryExecution().toString() for f in frames)
        got = [sorted(map(tuple, f.collect())) for f in frames]
        by_spark = by_spark or got
        assert got == by_spark
        with pytest.raises(ValueError, match="1 hidden"):
            manifest.read_files(spark, at)
    assert [len(rows) for rows in by_spark] == [28, 26, 1]
    assert dict(by_spark[1])[f"file:{folder}/link.txt"] == b"3"


def test_file_run_keeps_no_list_of_many_files_in_the_driver(spark, tmp_path, monkeypatch):
    texts = ["one\ntwo\n\nthree", "", None, "\u00e9t\u00e9 " * 300, "A" * 50, "A" * 50, *[f"line {i}\n{i}" for i in range(6)]]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    by_spark = sorted(map(tuple, registry.file_run(spark, str(tmp_path)).collect()))
    assert sum(n for _, n in by_spark) == 4 + 1 + 1 + 1 + 2 + 12
    monkeypatch.setattr(manifest, "INDEXED_FILES", 5)
    found = registry.file_run(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == by_spark
