"""The learned models against plain Python: a dictionary Kneser-Ney, and features one at a time."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import helpers
from glyphist.llm import quality_model as qm
from glyphist.llm.language_id import ORDER, identify_languages, train_language_model
from glyphist.llm.texts import Texts, gram_hashes, mixed, of_column, word_hashes, words_of

ODD = [None, "", "a", "  ", "Zebra zebra zebra zebra zebra", "Ünïcode 日本語 🙂 text text", "line\nline\tline", "1 2 3"]


def one(text: str) -> Texts:
    data = np.frombuffer(text.encode(), np.uint8)
    return Texts(data, np.array([0, len(data)]))


def padded(text: str) -> str:
    return "\x02" * (ORDER - 1) + text.lower()


class Dictionaries:
    """Interpolated Kneser-Ney with one dictionary per language and order."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in texts})
        self.counts = {}
        for lang in self.langs:
            whole = Counter(padded(t)[i : i + ORDER] for own, t in texts if own == lang for i in range(len(t.lower())))
            levels = {ORDER: whole}
            for n in range(ORDER - 1, 0, -1):
                levels[n] = Counter(gram[1:] for gram in levels[n + 1])
            self.counts[lang] = levels
        self.alphabet = len({g for lang in self.langs for g in self.counts[lang][1]}) + 1

    def p(self, lang: str, gram: str) -> float:
        n = len(gram)
        counts = self.counts[lang][n]
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        weight = discount * len(same) / sum(same) if same else 1.0
        lower = self.p(lang, gram[1:]) if n > 1 else 1 / self.alphabet
        return max(counts[gram] - discount, 0) / max(sum(same), 1) + weight * lower

    def entropy(self, lang: str, text: str) -> float:
        whole = padded(text)
        return -sum(math.log(self.p(lang, whole[i : i + ORDER])) for i in range(len(text.lower()))) / len(text.lower())


def sentences(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_language_models_are_those_of_dictionaries(spark):
    rng = random.Random(21)
    words = {"aa": "the cat sat Über on mats 日".split(), "bb": "el gato está sobre la cat".split(), "cc": ["zz"]}
    training = [(lang, t) for lang, own in words.items() for t in sentences(rng, own, 12 if lang != "cc" else 1)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(training)]
    rows.append((3, training[3][1], training[3][0]))
    made = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by_hand = Dictionaries([(lang, t) for _, t, lang in rows])
    assert made.model.langs == by_hand.langs
    tests = [t for t in ODD if t] + sentences(rng, words["aa"], 3) + sentences(rng, words["bb"], 3) + ["xyz " * 50]
    data = [t.encode() for t in tests]
    at = np.cumsum([0, *map(len, data)])
    found, _ = made.model.entropies(Texts(np.frombuffer(b"".join(data), np.uint8), at))
    want = [[by_hand.entropy(lang, t) for lang in by_hand.langs] for t in tests]
    assert np.abs(found - np.array(want)).max() < 1e-4
    # Every context's probabilities sum to one over the alphabet and one unseen character.
    for context in ("\x02" * (ORDER - 1), "the"[-(ORDER - 1) :], "qqq"[: ORDER - 1]):
        letters = {g for lang in by_hand.langs for g in by_hand.counts[lang][1]} | {"￿"}
        assert sum(by_hand.p("aa", context + c) for c in letters) == pytest.approx(1)
    docs = helpers.table(spark, ODD + tests)
    got = {r.doc_id: r for r in identify_languages(docs, made).collect()}
    for i, text in enumerate(ODD + tests):
        if text and re.search(r"[^\W\d_]", text):
            entropies = [by_hand.entropy(lang, text) for lang in by_hand.langs]
            nearest = sorted(entropies)
            if nearest[1] - nearest[0] > 1e-3:
                assert got[i].lang_pred == by_hand.langs[int(np.argmin(entropies))]
        else:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)


def buckets_by_hand(text: str) -> list[int]:
    """One feature at a time, each hashed alone."""
    shift = np.uint64(64 - qm.BUCKET_BITS)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    result = [int(word_hashes(one(w), words_of(one(w)))[0] >> shift) for w in words]
    for i, word in enumerate(words):
        for back in range(1, 5):
            if i >= back and words[i - back] == word:
                result.append(int(mixed(np.array([back], np.uint64))[0] >> shift))
    for n in qm.GRAM_SIZES:
        for i in range(len(text) - n + 1):
            points = np.array([ord(c) for c in text[i : i + n]], np.uint32)
            result.append(int(gram_hashes(points, n)[0] >> shift))
    return result


def test_scores_are_those_of_features_one_at_a_time(spark):
    """Repeated rows, a null id, a very long text and odd texts, by a model that was fitted."""
    rng = random.Random(22)
    good, bad = sentences(rng, "clear words in good order".split(), 20), sentences(rng, "$$$ buy BUY now".split(), 20)
    texts = good + bad
    docs = helpers.table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(5, None), (None, 1), (7, 3)], "doc_id long, label int")
    model = qm.train_quality_model(docs, labels, dim=8, epochs=3)
    asked = ODD + [texts[0], texts[0], texts[25], "clear words " * 20_000]
    scored = qm.quality_scores(helpers.table(spark, asked, [*range(len(asked) - 1), None]), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    for i, text in zip([*range(len(asked) - 1), None], asked):
        short = (text or "")[: 12 * 30] if i is None else text or ""
        found = buckets_by_hand(short)
        vectors = model.embeddings[found]
        mean = vectors.mean(axis=0) if found else np.zeros(8)
        logits = mean @ model.output + model.bias
        want = 1 / (1 + math.exp(float(logits[0] - logits[1])))
        assert got[i] == pytest.approx(want, abs=0.02 if i is None else 1e-4)
    assert got[8] == got[9] and sum(got[i] > 0.5 for i in (8, 9)) == 2 and got[10] < 0.5


def test_columns_of_texts_and_single_texts_have_the_same_features():
    import pyarrow as pa

    texts = [t for t in ODD if t is not None] + ["word " * 9]
    buckets, owners = qm.feature_buckets(of_column(pa.array(texts)))
    for i, text in enumerate(texts):
        assert sorted(buckets[owners == i].tolist()) == sorted(buckets_by_hand(text))
