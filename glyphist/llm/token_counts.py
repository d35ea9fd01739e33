"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphist.llm.texts import all_slices

TOKEN_LIMIT = 2048
# Counts kept by each task; all are dropped when there are more, so memory is bounded.
CACHED_WORDS = 400_000

_WORD_END = "</w>"
# What str.split() takes for white space and the Unicode property does not.
_SPLIT_ONLY = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of byte-level pairs.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters
    from U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class PairMerges:
    """Merge ranks of a vocabulary with word ends, and the count for one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self._ranks = {}
        for rank, (left, right) in enumerate(pairs):
            self._ranks.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        letters = byte_letters()
        self._inner = [vocabulary[c] for c in letters]
        self._last = [vocabulary[c + _WORD_END] for c in letters]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # \\s of the vocabulary file is the Unicode property, which regex calls by name.
        self.pattern = splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, word: str) -> int:
        """Symbols left of a word when no adjacent pair has a rank any more."""
        data = word.encode()
        n = len(data)
        symbols = [self._inner[b] for b in data]
        symbols[-1] = self._last[data[-1]]
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._ranks
        heap = []
        for i in range(n - 1):
            pair = ranks.get((symbols[i], symbols[i + 1]))
            if pair:
                heap.append((pair[0], i, symbols[i], symbols[i + 1], pair[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = following[i]
            # Entries of symbols that were merged meanwhile are stale.
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            merges += 1
            symbols[i], symbols[j] = merged, -1
            after = following[i] = following[j]
            if after < n:
                previous[after] = i
                pair = ranks.get((merged, symbols[after]))
                if pair:
                    heapq.heappush(heap, (pair[0], i, merged, symbols[after], pair[1]))
            before = previous[i]
            if before >= 0:
                pair = ranks.get((symbols[before], merged))
                if pair:
                    heapq.heappush(heap, (pair[0], before, symbols[before], merged, pair[1]))
        return n - merges


def _unknown_letters() -> str:
    """A character class of letters and digits that are newer than the tables of Python's ``unicodedata``.

    The tokenizer library does not know them either and cuts them as marks, while ``regex`` does.
    """
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranges: list[list[int]] = []
    for point in found:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


def word_cutter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern over letters and digits, as far as the tokenizer library knows them."""
    find = regex.compile(pattern).findall
    strict: list = []

    def cut(text: str) -> list[str]:
        if text.isascii():
            return find(text)
        if not strict:
            unknown = _unknown_letters()
            known = pattern.replace(r"\p{L}", rf"[\p{{L}}--{unknown}]").replace(r"\p{N}", rf"[\p{{N}}--{unknown}]")
            strict.extend([regex.compile(unknown).search, regex.compile("(?V1)" + known).findall])
        return strict[1](text) if strict[0](text) else find(text)

    return cut


class TextCounter:
    """Tokens of whole texts: special strings, normalising, words, then merges of each word."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self._merges = PairMerges(path)
        self._find = word_cutter(self._merges.pattern)
        self._special = None
        if self._merges.special:
            longest_first = sorted(self._merges.special, key=len, reverse=True)
            self._special = regex.compile("|".join(regex.escape(s) for s in longest_first))
        self._words: dict[str, int] = {}
        self._chunks: dict[str, int] = {}
        self._cached = cached

    def _chunk(self, chunk: str) -> int:
        # Lower-casing is by character: a capital sigma never becomes a final one.
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if len(self._words) > self._cached:
            self._words.clear()
        total = 0
        for word in self._find(text):
            n = self._words.get(word)
            if n is None:
                n = self._words[word] = self._merges.count(word)
            total += n
        return total

    def _plain(self, text: str) -> int:
        """Words never cross white space, so each distinct chunk between it is counted once."""
        if _SPLIT_ONLY.search(text):
            return self._chunk(text)
        chunks = text.split()
        known = self._chunks
        missing = set(chunks).difference(known)
        if missing:
            if len(known) > self._cached:
                known.clear()
                missing = set(chunks)
            for chunk in missing:
                known[chunk] = self._chunk(chunk)
        return sum(map(known.__getitem__, chunks))

    def count(self, text: str) -> int:
        if self._special is None or not (found := self._special.findall(text)):
            return self._plain(text)
        return len(found) + sum(map(self._plain, self._special.split(text)))


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, in one pass without a shuffle.

    ``vocabulary`` is the path of a byte-pair vocabulary with word ends, on every machine.
    Special strings inside a text count one token each. A null or empty text has 0 bytes
    and 0 tokens; repeated rows give repeated results; an empty table gives no rows. Other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(vocabulary)
        for part, texts in all_slices(batches):
            tokens = [counter.count(t) if t else 0 for t in part.column("text").to_pylist()]
            counts = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts.sizes), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
