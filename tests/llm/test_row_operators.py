"""Operators that look at one text at a time, and sharding and packing."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import helpers
from glyphist.llm import packing, token_counts
from glyphist.llm.language_id import identify_languages, train_language_model
from glyphist.llm.licenses import known_licenses, license_matches
from glyphist.llm.packing import pack_documents
from glyphist.llm.quality_model import quality_scores, train_quality_model
from glyphist.llm.sharding import byte_size_shards
from glyphist.llm.texts import SortedHashes, Spans, Texts, constants, words_of

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_equal_spans_have_equal_hashes():
    data = np.frombuffer(b"abcabc" * 10, np.uint8)
    spans = Spans(data)
    same = spans.hashes(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert len(set(same.tolist())) == 1
    assert spans.hashes(np.array([1]), np.array([4]))[0] != same[0]


def test_words_end_with_their_text():
    texts = Texts(np.frombuffer(b"ab cd" + b"" + b"ef ", np.uint8), np.array([0, 5, 5, 8]))
    words = words_of(texts)
    assert words.start.tolist() == [0, 3, 5] and words.end.tolist() == [2, 5, 7] and words.counts.tolist() == [2, 0, 1]


def test_sorted_hashes_find_what_they_hold():
    held = np.sort(constants(1, 5000))
    table, other = SortedHashes(held), constants(2, 5000)
    assert (table.find(held) == np.arange(5000)).all() and (table.find(other) == -1).all()
    assert (SortedHashes(held[:0]).find(other) == -1).all()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
@example("Â\U000323b0 a\U000323b0b\u0558 \u0558")
def test_tokens_are_those_of_the_library(text):
    want = Tokenizer.from_file(WORD_VOCABULARY) if not hasattr(helpers, "words") else helpers.words
    ids = Tokenizer.from_file(BYTE_VOCABULARY) if not hasattr(helpers, "bytes_") else helpers.bytes_
    helpers.words, helpers.bytes_ = want, ids
    helpers.counter = getattr(helpers, "counter", None) or token_counts.TextCounter(WORD_VOCABULARY, 50)
    helpers.encoder = getattr(helpers, "encoder", None) or packing.TextIds(BYTE_VOCABULARY, 50)
    for t in (text, text.replace("0", " "), text + "<|endoftext|>" + text):
        assert helpers.counter.count(t) == len(want.encode(t, add_special_tokens=False).ids)
        got = np.frombuffer(helpers.encoder.ids(t), "<u4").tolist()
        assert got == ids.encode(t, add_special_tokens=False).ids


def test_a_word_is_cut_into_tokens_once():
    """Its ids are those before a mark too, and 100,000 other words do not push them out."""
    encoder = packing.TextIds(BYTE_VOCABULARY)
    library, asked = encoder._model, []
    encoder._model = type("Counting", (), {"tokenize": lambda _, word: asked.append(word) or library.tokenize(word)})()
    far = " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(100_000))
    texts = ["a harbour", "a harbour, naïve", "the harbour. naïve; of", far, far[:40], "one harbour"]
    want = [Tokenizer.from_file(BYTE_VOCABULARY).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.ids(t), "<u4").tolist() for t in texts] == want
    assert asked.count("Ġharbour") == 1 and len(asked) == len(set(asked))


def test_token_counts_of_odd_rows(spark):
    docs = helpers.odd_table(spark)
    library = Tokenizer.from_file(WORD_VOCABULARY)
    want = []
    for doc, text in docs.select("doc_id", "text").collect():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 2048))
    got = token_counts.token_counts(docs, WORD_VOCABULARY)
    assert helpers.rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), WORD_VOCABULARY).count() == 0


def test_shards_are_contiguous_and_even(spark):
    docs = helpers.odd_table(spark)
    rows = sorted(byte_size_shards(docs, 4).collect(), key=lambda r: r.first_byte)
    at, slots = 0, {}
    for r in rows:
        assert r.first_byte == at and r.slot == slots.get(r.shard, 0) and r.law == "bytes" and r.grown_shard is None
        at, slots[r.shard] = at + r["size"], r.slot + 1
    assert [r.shard for r in rows] == sorted(r.shard for r in rows) and len(rows) == docs.count()
    texts = [t for (t,) in docs.select("text").collect()]
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    even = byte_size_shards(spark.range(1600).selectExpr("id % 3 AS doc_id", "'abc' AS text"))
    assert {r["n"] for r in even.groupBy("shard").count().withColumnRenamed("count", "n").collect()} == {100}
    assert byte_size_shards(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_fillings_hold_every_piece(counts):
    fillings = packing.bin_completion(counts, 40)
    held = {}
    for filling, times in fillings:
        assert sum(filling) <= 40
        for size in filling:
            held[size] = held.get(size, 0) + times
    used = sum(t for _, t in fillings)
    assert held == counts and used >= packing.lower_bound(counts, 40)
    assert used <= sum(t for _, t in packing.best_fit(counts, 40))


def test_search_finds_what_best_fit_misses():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}  # 38 tokens in sequences of 10
    assert sum(t for _, t in packing.bin_completion(counts, 10)) == 4


def test_packing_of_odd_rows(spark):
    docs = helpers.odd_table(spark)
    rows = pack_documents(docs, BYTE_VOCABULARY, 64).collect()
    library, want = Tokenizer.from_file(BYTE_VOCABULARY), []
    for doc, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        start, length = 0, len(ids) % 64 or 64
        while start < len(ids):
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            want.append((doc, start, length, crc))
            start, length = start + length, 64
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == sorted(want, key=repr)
    places = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 64
    assert pack_documents(docs.limit(0), BYTE_VOCABULARY).count() == 0


def test_licences_in_odd_rows(spark):
    mit = next(t for name, kind, t in helpers_licenses() if name == "MIT" and kind == "text")
    written = "Copyright (c) 2020 Someone\n" + mit.replace("Permission", "PERMISSION").replace(", ", " , ")
    texts = [None, "", written, "x\nLicensed  under the MIT licence!\nLicensed under the MIT License.", "MIT", "copyright 2020"]
    got = license_matches(helpers.table(spark, texts), known_licenses(spark))
    assert helpers.rows_of(got, "doc_id", "unit", "license", "kind", "n_units") == [
        (2, "document", "MIT", "text", 1), (3, "line", "MIT", "notice", 2),
    ]
    assert license_matches(helpers.table(spark, texts), known_licenses(spark).limit(0)).count() == 0


def test_every_licence_of_the_catalogue_is_found(spark):
    """Whole texts under a copyright line, in other case and line breaks; repeated rows, a null id, a very long text."""
    names, texts = [], []
    for name, kind, text in helpers_licenses():
        names.append(name)
        texts.append(f"Copyright (c) 1999-2024 The Authors\n\n{text.upper()}" if kind == "text" else text)
    files = {
        "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0",
        "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    for file, name in files.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            names.append(name)
            texts.append("  " + path.read_text().replace("\n", " \n"))
    ids = list(range(len(texts)))
    long = "word " * 300_000 + "\nLicensed under CC BY 4.0."
    more = [texts[0], texts[0], long, texts[-1][:-40]]
    docs = helpers.table(spark, texts + more, [*ids, 0, None, 1000, 1001])
    got = license_matches(docs, known_licenses(spark))
    found = {(r.doc_id, r.license): r.n_units for r in got.filter("unit = 'document'").collect()}
    assert found == {**{(i, n): 1 for i, n in zip(ids, names)}, (0, names[0]): 2, (None, names[0]): 1}
    assert [tuple(r) for r in got.filter("doc_id = 1000").collect()] == [(1000, "line", "CC-BY-4.0", "notice", 1)]


def helpers_licenses():
    from glyphist.llm.licenses import LICENSE_TEXTS

    return LICENSE_TEXTS


def test_languages_of_odd_rows(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, "".join(rng.choice(alphabets[lang] + " ") for _ in range(80)), lang) for i in range(60) for lang in alphabets]
    model = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "123 !", "abcab cdeab", "vwx yzvw", "ABC DEAB", "日本語"]
    got = {r.doc_id: r for r in identify_languages(helpers.table(spark, texts), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got[3].score > 0.9 and got[0].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    seen = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert got[6].rejected and seen.filter("rejected").count() <= 2
    nothing = train_language_model(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in identify_languages(helpers.table(spark, texts), nothing).collect()} == {"und"}


def test_a_rare_language_is_learned_beside_millions_of_grams(spark):
    rng = random.Random(16)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 200)]
    rows = [(i, "".join(rng.choices(letters, k=2500)), "aa") for i in range(840)]
    rows.append((1000, "the quick brown fox jumps over a lazy dog", "zz"))
    model = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), calibration_rows=20)
    assert model.model.langs == ["aa", "zz"] and len(model.model.levels[4].table) > 2_000_000
    lang, _, _ = model.predict(Texts(np.frombuffer(b"the lazy brown dog", np.uint8), np.array([0, 18])))
    assert lang.tolist() == ["zz"]


def test_limits_and_scale_of_languages_come_from_all_texts(spark):
    from glyphist.llm.language_id import REJECT_ABOVE, SCALES, posterior_exponent

    rng = random.Random(17)
    words = {"aa": "the cat sat on a mat".split(), "bb": "el gato the sat la mat".split()}
    langs = [rng.choice("ab") * 2 for _ in range(4000)]
    texts = [" ".join(rng.choices(words[lang], k=rng.randrange(1, 8))) for lang in langs]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))] + [(5000, "", "aa")]
    model = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data = [t.encode() for t in texts]
    joined = Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    entropy, length = model.model.entropies(joined)
    true = np.array([model.model.langs.index(lang) for lang in langs])
    own = entropy[np.arange(len(true)), true]
    assert np.allclose(model.limits, [np.quantile(own[true == i], REJECT_ABOVE) for i in range(2)], rtol=1e-12)
    exponents = [posterior_exponent(entropy, length, scale) for scale in SCALES]
    losses = [(e[np.arange(len(true)), true] + np.log(np.exp(-e).sum(axis=1))).sum() for e in exponents]
    assert model.scale == SCALES[int(np.argmin(losses))]


def test_quantiles_are_exact(spark):
    from glyphist.llm.language_id import quantiles

    rng = np.random.default_rng(3)
    values = {"aa": rng.normal(size=9000), "bb": rng.integers(0, 5, 7000) / 4, "cc": np.array([2.5])}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("aa", None)]
    frame = spark.createDataFrame(rows, "lang string, v double").repartition(5)
    for share in (0.0, 0.5, 0.9, 0.999, 1.0):
        found = quantiles(frame, "lang", "v", share)
        assert found == pytest.approx({k: np.quantile(own, share) for k, own in values.items()}, rel=1e-12)


def test_language_probabilities_add_up(spark):
    from glyphist.llm.language_id import ORDER, GramCounter, KneserNey, padded_points

    text = Texts(np.frombuffer(b"the cat sat on the mat and the cat ran", np.uint8), np.array([0, 38]))
    counter = GramCounter(ORDER)
    counter.add(padded_points(text))
    model = KneserNey(["en"], counter.grams, counter.counts[:, None])
    letters = np.unique(counter.grams[:, -1])
    for context in counter.grams[:5, :-1]:
        points = np.concatenate([np.append(context, z) for z in letters]).astype(np.uint32)
        p = np.exp(model.log_probabilities(points, np.arange(len(letters)) * ORDER).astype(float))
        assert p.sum() <= 1 + 1e-5 and p.sum() + np.exp(model.unseen[0]) > 1 - 0.05


def test_quality_scores_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, helpers.sentence(rng, 40) if i % 2 else "### " + " *** ".join("ABC" for _ in range(30)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    model = train_quality_model(docs, labels)
    scored = quality_scores(helpers.table(spark, [None, "", helpers.sentence(rng, 50), "ABC *** ABC ### ABC"]), model)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert score[0] == score[1] and score[2] > 0.9 > 0.1 > score[3]
    assert train_quality_model(docs.limit(0), labels) is None
    assert [r.score for r in quality_scores(docs.limit(1), None).collect()] == [0.5]


def test_quality_model_reaches_accuracy_on_held_out_rows(spark, sf):
    from glyphist.llm.queries import op2_quality_classifier

    got = op2_quality_classifier(spark, sf).filter("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = got.join(labels, "doc_id").selectExpr("avg(CAST(predicted = quality AS DOUBLE)) AS a").first().a
    assert right >= 0.9


def test_language_model_reaches_accuracy_on_held_out_rows(spark, sf):
    from glyphist.llm.queries import op6_language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, sf).filter("held_out").join(docs, "doc_id")
    assert got.selectExpr("avg(CAST(lang_pred = lang AS DOUBLE)) AS a").first().a >= 0.9


@pytest.mark.parametrize("name", ["op1_sharding", "op10_license_scan", "op3_quality_rules", "op8_near_duplicates"])
def test_statements_agree(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry
    from checks.compare import rows_of

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = entry.queries()[name](spark, sf)
    answer = duck.sql(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(answer.columns, answer.fetchall())
