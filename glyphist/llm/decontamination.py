"""Benchmark passages in documents: SimHash windows, then exact weighted-shingle similarity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.llm.steps import Steps
from glyphist.llm.texts import SortedHashes, Texts, all_slices, of_column, shingle_hashes, word_hashes, words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# 8 blocks of 8 bits, each searched within 2 bits: all fingerprints within 3 * 8 - 1 bits are found.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
# Items are searched for in blocks of at most this many bytes of text, one pass over the documents each.
ITEM_BYTES = 32 << 20

_U = np.uint64
_BITS = _U(1) << np.arange(64, dtype=np.uint64)
_NEAR = [0] + [sum(1 << b for b in bits) for r in range(1, BLOCK_RADIUS + 1) for bits in combinations(range(8), r)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return np.where(hashes[:, None] & _BITS, 1, -1).astype(np.int32)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash from the sums of signs: bit b is set if more hashes have it than not."""
    return ((sums > 0) * _BITS).sum(axis=1, dtype=np.uint64)


@dataclass
class FingerprintIndex:
    """Multi-index blocks: which fingerprints have a given value in a given block."""

    prints: np.ndarray
    blocks: list[dict[int, list[int]]] = field(default_factory=list)

    @classmethod
    def of(cls, prints: np.ndarray) -> FingerprintIndex:
        blocks = []
        for b in range(BLOCKS):
            lists: dict[int, list[int]] = defaultdict(list)
            for i, value in enumerate(((prints >> _U(8 * b)) & _U(255)).tolist()):
                lists[value].append(i)
            blocks.append(dict(lists))
        return cls(prints, blocks)

    def within(self, fingerprint: int, radius: int = RADIUS) -> set[int]:
        """All fingerprints at most ``radius`` bits away: one block has at most radius // 8 of them."""
        found: set[int] = set()
        for b, lists in enumerate(self.blocks):
            value = (fingerprint >> (8 * b)) & 255
            for near in _NEAR:
                found.update(lists.get(value ^ near, ()))
        return {i for i in found if (fingerprint ^ int(self.prints[i])).bit_count() <= radius}


@dataclass
class Hit:
    row: int
    item: int
    start_word: int
    n_words: int
    similarity: float


class ItemIndex:
    """Benchmark items: their shingles with weights, and an index of fingerprints by size."""

    def __init__(self, ids: list, texts: Texts, similarity: float = SIMILARITY):
        self.ids, self.similarity = ids, similarity
        lowered = texts.lowered()
        words = words_of(lowered)
        hashes = word_hashes(lowered, words)
        self.sizes = words.counts
        self.weights: list[dict[int, int]] = []
        prints, where = [], defaultdict(list)
        for i in range(len(texts)):
            own = shingles_in(hashes[words.first[i] : words.first[i + 1]])
            values, counts = np.unique(own, return_counts=True)
            self.weights.append(dict(zip(values.tolist(), counts.tolist())))
            prints.append(fingerprints(signs(own).sum(axis=0, keepdims=True))[0] if len(own) else _U(0))
            for value in values.tolist():
                where[value].append(i)
        self.shingles = SortedHashes(np.array(sorted(where), np.uint64))
        self.items_of = [where[h] for h in self.shingles.hashes.tolist()]
        prints = np.array(prints, np.uint64)
        # Windows of n words are compared with the items of n words.
        self.by_size = {}
        for n in set(self.sizes.tolist()) - {0}:
            members = np.flatnonzero(self.sizes == n)
            self.by_size[n] = (members, FingerprintIndex.of(prints[members]))

    def needed(self, item: int, weight: int | None = None) -> int:
        """Least weight that a similar window of ``weight``, or of the item's own, shares with the item."""
        total = sum(self.weights[item].values())
        both = total + (total if weight is None else weight)
        return int(np.ceil(both * self.similarity / (1 + self.similarity) - 1e-9))

    def hits(self, texts: Texts) -> list[Hit]:
        """Best window of every (text, item) whose similarity reaches the limit."""
        lowered = texts.lowered()
        words = words_of(lowered)
        hashes = word_hashes(lowered, words)
        found = []
        shingles = shingle_hashes(hashes, SHINGLE_WORDS)
        owner = np.repeat(np.arange(len(texts)), words.counts)
        known = self.shingles.find(shingles)
        if len(shingles):
            known[owner[: len(shingles)] != owner[SHINGLE_WORDS - 1 :]] = -1
        marked = np.flatnonzero(known >= 0)
        for row, first, last in _runs(owner[marked]):
            found += self._in_text(row, hashes[words.first[row] : words.first[row + 1]], known[marked[first:last]], marked[first:last] - words.first[row])
        for row in np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE_WORDS)):
            # Too short for a shingle: the text as a whole is one.
            own = hashes[words.first[row] : words.first[row + 1]]
            at = self.shingles.find(shingles_in(own))
            if at[0] >= 0:
                found += [Hit(int(row), i, 0, len(own), 1.0) for i in self.items_of[at[0]] if self.sizes[i] == len(own)]
        return found

    def _in_text(self, row: int, hashes: np.ndarray, known: np.ndarray, places: np.ndarray) -> list[Hit]:
        # A window similar to an item holds nearly all of its shingles: most texts end here.
        at: dict[int, list[int]] = defaultdict(list)
        for shingle, place in zip(known.tolist(), places.tolist()):
            for item in self.items_of[shingle]:
                at[item].append(place)
        sizes = defaultdict(list)
        hits = []
        shingles = shingle_hashes(hashes, SHINGLE_WORDS)
        for item, own in at.items():
            if self.sizes[item] > len(hashes):
                # The whole text is the one window; so few are compared that no fingerprint is asked.
                if len(own) >= self.needed(item, len(shingles)):
                    value = self._similarity(item, shingles)
                    if value >= self.similarity:
                        hits.append(Hit(row, item, 0, len(hashes), value))
            elif len(own) >= self.needed(item):
                sizes[int(self.sizes[item])].append(item)
        for n, items in sizes.items():
            width = n - SHINGLE_WORDS + 1
            wanted = set(items)
            members, index = self.by_size[n]
            # Windows that share a shingle with one of the items start less than a width before it.
            begins = np.unique(np.concatenate([np.array(at[i]) for i in items]))
            spans = np.maximum(begins - width + 1, 0)[:, None] + np.arange(width)
            starts = np.unique(spans[(spans <= begins[:, None]) & (spans <= len(hashes) - n)])
            best: dict[int, Hit] = {}
            for low, high in _stretches(starts):
                sums = np.cumsum(signs(shingles[low : high + width]), axis=0)
                sums = np.concatenate([np.zeros((1, 64), np.int64), sums])
                prints = fingerprints(sums[width:] - sums[:-width])
                for start, fingerprint in zip(range(low, high + 1), prints.tolist()):
                    for near in index.within(fingerprint):
                        item = int(members[near])
                        if item in wanted:
                            value = self._similarity(item, shingles[start : start + width])
                            if value >= self.similarity and (item not in best or value > best[item].similarity):
                                best[item] = Hit(row, item, start, n, value)
            hits += best.values()
        return hits

    def _similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard: shared over joint multiplicities of shingles."""
        values, counts = np.unique(window, return_counts=True)
        own = self.weights[item]
        shared = sum(min(own.get(v, 0), c) for v, c in zip(values.tolist(), counts.tolist()))
        return shared / (sum(own.values()) + len(window) - shared)


def shingles_in(hashes: np.ndarray) -> np.ndarray:
    """Shingles of one text's words; fewer words than a shingle make one of their own."""
    if len(hashes) >= SHINGLE_WORDS or not len(hashes):
        return shingle_hashes(hashes, SHINGLE_WORDS)
    return shingle_hashes(hashes, len(hashes)) ^ _U(len(hashes))


def _runs(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(owner)) + 1
    bounds = [0, *cuts.tolist(), len(owner)]
    for first, last in zip(bounds, bounds[1:]):
        if last > first:
            yield int(owner[first]), first, last


def _stretches(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    for low, high in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(starts) - 1]])):
        if len(starts):
            yield int(starts[low]), int(starts[high])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = ITEM_BYTES) -> Iterator[pa.Table]:
    """The benchmark in blocks of at most ``limit`` bytes of text (or one longer item).

    Rows are numbered when they are written, and blocks cut between any two of them: null and
    repeated ids are rows like others. The driver holds a block at a time, and one number per block.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= limit:
        yield items.toArrow()
        return
    numbered = items.withColumn("_row", F.monotonically_increasing_id())
    steps = Steps(benchmark.sparkSession, "items")
    held = steps.keep(numbered, "items")
    bounds, total = [], 0
    for row in held.select("_row", F.octet_length("text").alias("n")).orderBy("_row").toLocalIterator():
        if not bounds or total + row.n > limit:
            bounds.append(row["_row"])
            total = 0
        total += row.n
    for low, high in zip(bounds, [*bounds[1:], None]):
        block = held.filter(F.col("_row") >= low)
        yield (block if high is None else block.filter(F.col("_row") < high)).drop("_row").toArrow()
    steps.drop(held)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY):
    for block in item_blocks(benchmark, id_col, text_col):
        if block.num_rows:
            texts = of_column(block["text"].combine_chunks())
            yield ItemIndex(block["item_id"].to_pylist(), texts, similarity)


def contaminations(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, similarity)``: every benchmark item in a document.

    Items and whole documents are lower-cased (A-Z) and cut into words. A document holds
    an item if a window with as many words has a weighted five-word-shingle Jaccard
    similarity of at least ``similarity``; the best window, the first on a tie, is given. A
    document with fewer words than the item is one window. Items and documents of fewer
    than five words are one shingle each. Fingerprints within 23 of 64
    bits are candidates; windows are looked at where the document shares enough shingles
    with an item to be similar at all.

    Null and empty texts of either side match nothing, equal items match alike, repeated
    rows give repeated results, an empty benchmark none. Clean documents have no row.
    Documents are read once for every block of the benchmark and never shuffled.
    """
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    result = None
    for index in indexes(benchmark, similarity=similarity):

        def run(batches: Iterable[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for part, texts in all_slices(batches):
                hits = index.hits(texts)
                if hits:
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[h.row] for h in hits], pa.int64()),
                            pa.array([index.ids[h.item] for h in hits], pa.int64()),
                            pa.array([h.start_word for h in hits], pa.int64()),
                            pa.array([h.n_words for h in hits], pa.int64()),
                            pa.array([h.similarity for h in hits], pa.float64()),
                        ],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        found = rows.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    for index in indexes(benchmark, similarity=similarity):

        def run(batches: Iterable[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for part, texts in all_slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[h.row for h in index.hits(texts)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
