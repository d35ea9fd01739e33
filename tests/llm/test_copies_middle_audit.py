"""Exact duplicates, fill-in-the-middle and the filter audit against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers
from glyphist.llm import exact_duplicates as copies
from glyphist.llm.exact_duplicates import exact_duplicates, normalised, with_first_copy, without_copies
from glyphist.llm.fill_in_middle import _unused_character, cut, fill_in_middle, restored
from glyphist.llm.filter_audit import Orders, failing, filter_audit
from glyphist.llm.steps import Steps

SPACES = ["a b", "a  b", "a\tb", " a b", "a b ", "a\n\r\x0b\x0cb", " ", "\t\t", "", None, "a b", "A b", "a b"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups_of(rows):
    """(doc_id, keep_id, group_size, kept, sha) by a dictionary of texts."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[plain(text)].append((doc is None, doc or 0, i, doc))
    result = []
    for text, members in groups.items():
        first = min(members)
        result += [(doc, first[3], len(members), i == first[2], sha(text)) for _, _, i, doc in members]
    return sorted(result, key=repr)


def odd_copies(spark):
    rows = [*enumerate(SPACES), (3, " a b"), (3, "a b"), (None, "a b"), (None, "x"), (None, "x"), (7, "long " * 60000), (6, "long  " * 60000)]
    return rows, helpers.table(spark, [t for _, t in rows], [i for i, _ in rows])


def test_copies_are_those_of_a_dictionary(spark):
    rows, docs = odd_copies(spark)
    got = exact_duplicates(docs.repartition(3))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert helpers.rows_of(got, "*") == groups_of(rows)
    kept = without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({plain(t) for _, t in rows})


@pytest.mark.parametrize("hashed", [lambda body: F.lit("one"), lambda body: (F.length(body) % 3).cast("string")])
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch, hashed, broadcast):
    monkeypatch.setattr(copies, "BROADCAST_NAMES", broadcast)
    rows, docs = odd_copies(spark)
    texts = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    got = with_first_copy(texts, Steps(spark, "copies"), lambda body: F.encode(hashed(body), "utf-8"))
    assert helpers.rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == groups_of(rows)


def test_many_repeated_names_are_grouped_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(copies, "BROADCAST_NAMES", 0)
    rows, docs = odd_copies(spark)
    assert helpers.rows_of(exact_duplicates(docs), "*") == groups_of(rows)


def test_copies_of_an_empty_table(spark):
    empty = helpers.table(spark, ["x"]).limit(0)
    assert exact_duplicates(empty).count() == 0 and without_copies(empty).columns == empty.columns


def test_copies_use_no_python(spark, sf):
    plan = exact_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Window" not in plan


def middle_of(doc, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output) as the rules say."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_follow_the_rules_and_can_be_restored(spark):
    texts = ["<P>", "a <S> b", "<M", "<P<S<M>", "x<", "<<PP>>", "S>a<", "\x1f\x1e a", "line\nline\r\n", "日本語 mixed ascii", "🙂" * 50, "é" * 9]
    texts += [f"{t} {i} <{t}" for i, t in enumerate("some words, 12 of them < P> <S <M >".split() * 12)]
    odd = helpers.odd_table(spark)
    docs = odd.unionByName(helpers.table(spark, texts, list(range(100, 100 + len(texts)))))
    docs = docs.unionByName(helpers.table(spark, ["word, " * 400_000], [9999]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [middle_of(*r) for r in rows]
    assert helpers.rows_of(got, "*") == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert helpers.rows_of(back, "*") == sorted(((d, t or "") for d, t in rows), key=repr)


def test_every_cut_joins_to_the_text():
    text = "ab, c\n日d"
    cuts = [(a, b) for a in range(9) for b in range(9)]
    n, parts = cut(pa.array([text] * 81, pa.large_string()), *(pa.array(x) for x in zip(*cuts)))
    assert set(n.to_pylist()) == {7}
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for (a, b), p, m, s in zip(cuts, *(x.to_pylist() for x in parts)):
        low, high = sorted((a % 8, b % 8))
        assert [p, m, s] == ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]


def test_the_mark_is_foreign_to_all_texts():
    texts = pa.array(["".join(map(chr, range(0, 32))), chr(0xE000), ""], pa.large_string())
    assert _unused_character(texts) == chr(0xE001)


def test_middles_of_an_empty_table(spark):
    assert fill_in_middle(helpers.table(spark, ["x"]).limit(0)).count() == 0


def failing_letters(rows):
    """The letters that each (doc, text) fails, by comparing with all others."""
    result = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        smaller = any(d is not None and doc is not None and d < doc and (t or "") == text for d, t in rows)
        result.append(fails + "E" * smaller)
    return result


def audit_of(rows, parts, good, toxic):
    fails = failing_letters(rows)
    shapley, result = Counter(), []
    for part in set(parts):
        mine = [i for i in range(len(rows)) if parts[i] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in fails[i]]
                earlier = sum(letter in fails[i] for i in mine) - len(gone)
                left = [i for i in left if letter not in fails[i]]
                shapley[part, letter] += len(gone)
                lost = [sum(rows[i][0] in marked for i in gone) for marked in (good, toxic)]
                result.append((part, order, step, len(left), len(gone), earlier, sum(fails[i] == letter for i in mine), *lost, letter))
    return sorted([(*r[:-1], shapley[r[0], r[-1]]) for r in result], key=repr)


def test_audit_is_that_of_applying_the_filters(spark):
    docs = helpers.odd_table(spark).unionByName(helpers.odd_table(spark, 2).withColumn("doc_id", F.col("doc_id") + 50).withColumn("lang", F.lit("de")))
    nowhere = helpers.table(spark, ["No Lang & x", "", None, "A | B " * 60, "<&>"], [200, 201, 202, 203, None], None)
    docs = docs.unionByName(nowhere).unionByName(nowhere.withColumn("lang", F.lit("")))
    labels = spark.createDataFrame(
        [(i, i % 2, (i // 2) % 2, "x") for i in range(0, 80)] + [(3, 0, 0, "y"), (None, 1, 1, "z"), (200, None, 1, "n"), (203, 1, None, "n")],
        "doc_id long, quality int, toxic int, lang string",
    )
    rows = [(r.doc_id, r.text, r.lang or "") for r in docs.collect()]
    marks = labels.collect()
    good = {r.doc_id for r in marks if r.quality == 1} - {None}
    toxic = {r.doc_id for r in marks if r.toxic == 1} - {None}
    got = filter_audit(docs, labels)
    want = audit_of([r[:2] for r in rows], [r[2] for r in rows], good, toxic)
    assert helpers.rows_of(got, "*") == want
    assert {w[2] for w in want} == {1, 2, 3, 4, 5} and len(want) == 600 * 3
    masks = helpers.rows_of(failing(docs, Steps(spark, "audit")), "doc_id", "part", "mask")
    letters = [(r[0], r[2], sum(1 << "ABCDE".index(x) for x in f)) for r, f in zip(rows, failing_letters([r[:2] for r in rows]))]
    assert masks == sorted(letters, key=repr)


def test_audit_without_documents_or_labels(spark):
    docs = helpers.odd_table(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), labels).count() == 0
    lost = filter_audit(docs, labels).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(lost) == (0, 0, 600)


def test_removal_steps_are_a_minimum():
    orders = Orders(4)
    assert orders.removal.shape == (24, 16) and (orders.removal[:, 0] == 4).all()
    for order, steps in zip(orders.orders.tolist(), orders.removal.tolist()):
        assert steps == [min((order.index(f) for f in range(4) if mask >> f & 1), default=4) for mask in range(16)]


@pytest.mark.parametrize("name", ["op11_exact_duplicates", "op12_fill_in_middle", "op13_filter_audit"])
def test_new_statements_agree(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry
    from checks.compare import rows_of

    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    answer = duck.sql(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(answer.columns, answer.fetchall())
