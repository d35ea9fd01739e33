"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, x1 long, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}ö" if rng.random() < 0.1 else f"word{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(rng: random.Random) -> list[str | None]:
    base = sentence(rng, 120)
    words = base.split()
    near = [*words]
    near[60] = "changed"
    passage = sentence(rng, 80)
    return [
        None, "", "   \n\t", "one", "two words", base, base, " ".join(near), base.upper(),
        sentence(rng, 60) + "\n" + passage, passage + "\n" + sentence(rng, 60), "é" * 700, "ab" * 900,
        sentence(rng, 5000, 4000), "### $$$ %%%\n### $$$ %%%\n", "Ünïcode 日本語 🙂 text",
        "Licensed under the MIT License.", "<|endoftext|> a  b \n c", sentence(rng, 60), sentence(rng, 61),
    ]


def table(spark, texts, ids=None, lang="en"):
    """Rows with columns of clashing names."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, lang, "s", None if t is None else len(t), "g", 1, 2) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_table(spark, seed: int = 1):
    """Odd texts, two rows with one id and different texts, one row twice, and a null id."""
    texts = odd_texts(random.Random(seed))
    rows = [*enumerate(texts), (5, sentence(random.Random(9), 70)), (18, texts[18]), (None, sentence(random.Random(8), 70))]
    return table(spark, [t for _, t in rows], [i for i, _ in rows])


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """``(doc_id, n_shingles, component_id)`` by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def removals(rows: list[tuple], length: int) -> list[tuple]:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` by counting all strings."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    result = []
    for doc, b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(c and not p for p, c in zip([0, *covered], covered))
        result.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return result


def passage_bytes(rows: list[tuple], words: int) -> list[tuple]:
    """``(doc_id, bytes)`` covered by strings of so many words that occur twice, by counting all of them."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for _, b in texts]
    windows = [[(s[i][0], s[i + words - 1][1]) for i in range(len(s) - words + 1)] for s in spans]
    times = Counter(b[x:y] for (_, b), own in zip(texts, windows) for x, y in own)
    result = []
    for (doc, b), own in zip(texts, windows):
        covered = bytearray(len(b))
        for x, y in own:
            if times[b[x:y]] > 1:
                covered[x:y] = b"\1" * (y - x)
        result.append((doc, sum(covered)))
    return result


def windows_like(items: list[tuple], rows: list[tuple], similarity: float) -> set[tuple]:
    """``(doc_id, item_id)`` by comparing every window of every document with every item."""

    def weights(words):
        if len(words) < 5:
            return Counter([tuple(words)]) if words else Counter()
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    found = set()
    for doc, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        for item, body in items:
            own = WORD.findall((body or "").translate(LOWER))
            if not own or (len(own) < 5 or len(words) < 5) and len(own) != len(words):
                continue
            a = weights(own)
            for i in range(len(words) - len(own) + 1):
                b = weights(words[i : i + len(own)])
                if sum((a & b).values()) >= similarity * sum((a | b).values()):
                    found.add((doc, item))
                    break
    return found


def rows_of(df, *columns) -> list[tuple]:
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
