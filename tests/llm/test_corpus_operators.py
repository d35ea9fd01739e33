"""Operators that compare texts with each other, and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import helpers
from glyphist.llm import decontamination as dc
from glyphist.llm import near_duplicates as nd
from glyphist.llm import quality_rules as qr
from glyphist.llm.components import components
from glyphist.llm.repeated_passages import removal_report, within_characters, without_repeats
from glyphist.llm.steps import Steps


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def near_group(rng, size, words=100, edits=12):
    base = helpers.sentence(rng, words).split()
    texts = []
    for _ in range(size):
        own = [*base]
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_odd_rows(spark, words, percent):
    docs = helpers.odd_table(spark)
    got = nd.near_duplicates(docs, words, percent)
    want = helpers.components(pairs(docs), words, percent)
    assert helpers.rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert got.filter("NOT (kept <=> (doc_id <=> component_id))").count() == 0
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [2048, 24, 8])
def test_large_regions_lose_no_link(spark, monkeypatch, limit):
    """With small limits the group's regions are followed down and crossed in blocks."""
    monkeypatch.setattr(nd, "REGION_SETS", limit)
    docs = helpers.table(spark, near_group(random.Random(3), 90) + near_group(random.Random(4), 40, edits=3))
    got = nd.near_duplicates(docs)
    assert helpers.rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(helpers.components(pairs(docs), 3, 85), key=repr)


def test_one_of_each_group_stays(spark):
    docs = helpers.odd_table(spark)
    kept = nd.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    rows = pairs(docs)
    groups = {}
    for (doc, text), (_, n, component) in zip(rows, helpers.components(rows, 5, 80)):
        if n:
            groups.setdefault((component, doc is None), set()).add(doc)
    wordless = [r for r, c in zip(rows, helpers.components(rows, 5, 80)) if not c[1]]
    left = pairs(kept)
    assert len(left) == len(set(left)) + len(wordless) - len(set(wordless))
    assert [r for r in left if not helpers.shingles(r[1], 5)] == sorted(wordless, key=lambda r: left.index(r))
    got = helpers.components(left, 5, 80)
    assert all(sum(a is b or set(helpers.shingles(a[1], 5)) == set(helpers.shingles(b[1], 5)) for b in left) == 1 for a in left if helpers.shingles(a[1], 5))
    assert len({c for _, n, c in got if n}) >= len(groups) - 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(map(tuple, components(Steps(spark, "test"), df).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert components(Steps(spark, "test"), df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [400, 64, 30])
def test_removals_of_odd_rows(spark, length):
    docs = helpers.odd_table(spark)
    got = removal_report(docs, length)
    want = helpers.removals(pairs(docs), length)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert helpers.rows_of(got, *columns) == sorted(want, key=repr)
    assert removal_report(docs.limit(0), length).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_removals_of_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(40)]
    docs = helpers.table(spark, texts)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert helpers.rows_of(removal_report(docs, 50), *columns) == sorted(helpers.removals(pairs(docs), 50), key=repr)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    from glyphist.llm import repeated_passages

    monkeypatch.setattr(repeated_passages, "PIECE_BYTES", 150)
    rng = random.Random(5)
    passage = helpers.sentence(rng, 30)
    docs = helpers.table(spark, [helpers.sentence(rng, 90) + passage, passage + helpers.sentence(rng, 200)])
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert helpers.rows_of(removal_report(docs, 100), *columns) == sorted(helpers.removals(pairs(docs), 100), key=repr)


def test_cut_texts_stay_valid(spark):
    assert within_characters("aé€b".encode(), 2, 5) == (3, 3)
    docs = helpers.odd_table(spark)
    cut = without_repeats(docs, 64)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert cut.filter("text IS NULL").count() == 1


def test_passages_are_counted_in_words(spark):
    rng = random.Random(15)
    short = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(51))
    fifty = " ".join(f"long{rng.randrange(10**9)}" for _ in range(50))
    copy = " ".join(rng.choice("abcdefgh") for _ in range(80))

    def around(passage):
        return helpers.sentence(rng, 60, 10**6) + f" {passage}\n" + helpers.sentence(rng, 60, 10**6)

    texts = [around(short) for _ in range(3)] + [around(fifty) for _ in range(2)] + [copy, copy, fifty, None, "", "x" * 300, "x" * 300]
    got = [r.text for r in corpus_pipeline.passage_dedup(spark, helpers.table(spark, texts), "").orderBy("doc_id").collect()]
    want = [t.replace(short, "") for t in texts[:3]] + texts[3:5] + ["", ""] + texts[7:]
    assert got == want


@pytest.mark.parametrize("words", [51, 9, 3])
def test_bytes_of_repeated_passages(spark, words):
    """Against counting all windows: short words, other white space, repeats in a text, copies of all lengths."""
    rng = random.Random(16)
    base = [rng.choice("abcdefghijé") for _ in range(90)]
    texts = [" ".join(base), "x y " + " ".join(base[20:80]) + " z", "\n".join(base), " ".join(base[:30] + base[:30] + base[10:]),
             "  " + " ".join(base[5:70]) + " \t", "  " + " ".join(base[5:70]) + " \t", "a b c", "a b c", "a b", "a b"]
    docs = helpers.odd_table(spark).unionByName(helpers.table(spark, texts, list(range(200, 210))))
    got = removal_report(docs, 400, words=words)
    want = helpers.passage_bytes(pairs(docs), words)
    assert helpers.rows_of(got, "doc_id", "n_passage_bytes") == sorted(want, key=repr)
    assert len({n for _, n in want}) > 5


def test_lengths_that_the_runs_cannot_hold_are_refused(spark):
    with pytest.raises(ValueError, match="4096"):
        removal_report(helpers.table(spark, ["x"]), 5000)


def test_contaminations_of_odd_rows(spark):
    rng = random.Random(6)
    items = [(i, helpers.sentence(rng, n)) for i, n in enumerate([3, 5, 14, 30, 59, 40])] + [(6, None), (7, ""), (8, "one")]
    long = items[5][1].split()
    near = " ".join([*long[1:], "end"])
    texts = [
        None, "", "one", items[0][1], items[1][1].upper(), helpers.sentence(rng, 90) + "\n" + items[2][1] + " " + items[3][1],
        near, helpers.sentence(rng, 200) + " " + items[4][1], " ".join(long[::-1]), items[5][1] + " " + items[5][1],
        helpers.sentence(rng, 3000),
    ]
    docs = helpers.table(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = helpers.windows_like([i for i in items], pairs(docs), 0.8)
    got = dc.contaminations(docs, benchmark)
    assert set(helpers.rows_of(got, "doc_id", "item_id")) == want and got.count() == len(want)
    kept = dc.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert dc.contaminations(docs, benchmark.limit(0)).count() == 0
    assert dc.contaminations(docs.limit(0), benchmark).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, helpers.sentence(rng, 20)) for i in range(30)]
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (300,))
    docs = helpers.table(spark, [t for _, t in items])
    got = dc.contaminations(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert helpers.rows_of(got, "doc_id", "item_id") == sorted(((i, i) for i, _ in items), key=repr)


def test_items_with_words_missing_are_found():
    import pyarrow as pa

    from glyphist.llm.texts import of_column

    rng = random.Random(14)
    items = [helpers.sentence(rng, n, 10**6).split() for n in (59, 110)]
    index = dc.ItemIndex([0, 1], of_column(pa.array([" ".join(i) for i in items])))
    short, long = items
    docs = [
        (short[1:], 0), (short[:-1], 0), (short[:29] + short[30:], 0),
        (long[10:], 1), (long[:-10], 1), (long[:50] + long[55:], 1), (long[:50] + long[60:], 1),
        (long[25:], None), (short[:20] + short[40:], None), (short[::-1][1:], None),
    ]
    want = set()
    for row, (doc, item) in enumerate(docs):
        a = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for i, own in enumerate(items):
            b = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            if len(a & b) >= 0.8 * len(a | b):
                want.add((row, i, 0, len(doc), round(len(a & b) / len(a | b), 9)))
    assert {w[:2] for w in want} == {(row, item) for row, (_, item) in enumerate(docs) if item is not None}
    hits = index.hits(of_column(pa.array([" ".join(d) for d, _ in docs])))
    assert {(h.row, h.item, h.start_word, h.n_words, round(h.similarity, 9)) for h in hits} == want and len(hits) == len(want)


def test_blocks_hold_null_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(13)
    texts = [helpers.sentence(rng, 20) for _ in range(24)]
    ids = [None, *range(10), *[10] * 12, 11]
    benchmark = spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string")
    blocks = list(dc.item_blocks(benchmark, "item_id", "text", 600))
    assert sorted(t for b in blocks for t in b["text"].to_pylist()) == sorted(texts)
    assert all(sum(len(t.encode()) for t in b["text"].to_pylist()) <= 600 for b in blocks)
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (600,))
    got = dc.contaminations(helpers.table(spark, texts), benchmark)
    assert helpers.rows_of(got, "doc_id", "item_id") == sorted(enumerate(ids), key=repr)


def test_all_fingerprints_within_the_radius_are_found():
    import numpy as np

    from glyphist.llm.texts import constants

    prints = constants(1, 400)
    index = dc.FingerprintIndex.of(prints)
    for p in constants(2, 50).tolist():
        want = {i for i, q in enumerate(prints.tolist()) if (p ^ q).bit_count() <= dc.RADIUS}
        assert index.within(p) == want
    assert np.uint64(0) not in prints


def test_quality_verdicts_of_odd_rows(spark):
    rng = random.Random(8)
    good = [helpers.sentence(rng, rng.randrange(60, 300)) for _ in range(260)]
    bad = [" ".join(f"{w}!!***$$$" for w in helpers.sentence(rng, 80).split()) for _ in range(5)]
    docs = helpers.table(spark, good + bad).union(helpers.odd_table(spark).selectExpr("doc_id + 1000 AS doc_id", *helpers_columns()))
    got = {r.doc_id: r for r in qr.quality_verdicts(docs).collect()}
    assert sum(not got[i].kept for i in range(260)) <= 2 and not any(got[i].kept for i in range(260, 265))
    assert got[1000].n_words == 0 and got[1000].base_failed and not got[1000].kept
    assert got[1014].n_dup_lines == 1 and got[1014].n_symbols == 18 and got[1014].n_repeat_words == 6
    kept = qr.good_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in qr.quality_verdicts(docs).select("kept").collect())
    assert qr.quality_verdicts(docs.limit(0)).count() == 0
    nulls = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert qr.quality_verdicts(nulls).filter("kept IS NULL").count() == 0


def test_small_groups_are_judged_with_their_language_and_with_all(spark):
    rng = random.Random(12)

    def rows(n, lang, source, first, symbols=""):
        texts = [" ".join(w + symbols for w in helpers.sentence(rng, rng.randrange(60, 300)).split()) for _ in range(n)]
        named = helpers.table(spark, texts, list(range(first, first + n)), lang)
        return named.withColumn("source", F.lit(source).cast("string"))

    # Junk alone in its source, its source unknown, its language rare or unknown; and good texts in small groups.
    junk = [rows(1, "en", "rare", 1000, "!!***$$$"), rows(1, "en", None, 1001, "!!***$$$"),
            rows(1, "xx", "s", 1002, "!!***$$$"), rows(1, None, None, 1003, "!!***$$$")]
    good = [rows(3, "en", "few", 2000), rows(3, "yy", "few", 2010)]
    docs = rows(260, "en", "s", 0)
    for part in junk + good:
        docs = docs.union(part)
    got = {r.doc_id: r for r in qr.quality_verdicts(docs).collect()}
    assert len(got) == 270 and not any(got[i].base_failed for i in got)
    assert [i for i in range(1000, 1004) if got[i].kept] == []
    assert all(got[i].kept for i in got if i >= 2000) and sum(not got[i].kept for i in range(260)) <= 2
    assert {r.doc_id for r in qr.good_documents(docs).collect()} == {i for i in got if got[i].kept}


def helpers_columns():
    return helpers.SCHEMA.replace(",", "").split(" ")[2::2]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    clean = [helpers.sentence(rng, rng.randrange(60, 200), 4000) for _ in range(240)]
    passage, item = helpers.sentence(rng, 70, 4000), helpers.sentence(rng, 30, 4000)
    near = clean[0].split()
    near[10] = "other"
    extra = [
        " ".join(near), clean[1], "too short", clean[2][:200] + " " + passage + " " + helpers.sentence(rng, 60, 4000),
        helpers.sentence(rng, 60, 4000) + " " + passage, helpers.sentence(rng, 60, 4000) + " " + item,
    ]
    helpers.table(spark, clean + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == before
    assert seen[0] == set(range(246)) - {242}
    assert seen[1] == seen[0] - {240, 241} and seen[2] == seen[1]
    assert seen[3] == seen[2] - {245} and seen[4] == seen[3]
    cut = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert passage not in cut[243] and passage not in cut[244] and all(cut[i] == clean[i] for i in range(3, 240))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert helpers.rows_of(whole, "doc_id", "piece", "ids_crc32") == helpers.rows_of(docs, "doc_id", "piece", "ids_crc32")
