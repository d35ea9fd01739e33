"""Text batches as NumPy byte arrays: words, hashes of spans, and shingles.

Everything here works on whole texts, many at a time, and needs no Spark session. Bytes
are UTF-8; white space is the six ASCII characters ``\\x20 \\x09-\\x0D``, which never occur
inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are handled in slices of about this many bytes; a longer text is a slice alone.
SLICE_BYTES = 1 << 20

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_VALUES = (constants(101, 256), constants(202, 256))
_BASE = _U(0x9FB21C651E98DF25)
_INVERSE_BASE = _U(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown_powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE_BASE)):
            steps = np.full(max(n, 1 << 16), base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    return _LOWER[data]


@dataclass
class Texts:
    """The bytes of several texts, one after the other; text i is ``data[at[i]:at[i + 1]]``."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def lowered(self) -> Texts:
        return Texts(lowered(self.data), self.at)

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def of_column(column: pa.Array) -> Texts:
    """Texts of an Arrow string column; null is the empty text."""
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(binary) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(all_bytes[at[0] : at[-1]], at - at[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together."""
    ends = np.cumsum(of_column(batch.column(column)).sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = batch.slice(first, last - first)
        yield part, of_column(part.column(column))
        first = last


def all_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        yield from slices(batch, column)


class Spans:
    """Hashes of any span of a text's bytes in constant time each."""

    def __init__(self, data: np.ndarray, table: int = 0):
        power, self._inverse = _grown_powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[table][data] * power[: len(data)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal bytes have equal hashes wherever they stand."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mixed(raw + (end - start).astype(np.uint64) * _U(0xD1B54A32D192ED03))


@dataclass
class Words:
    """Words of several texts: byte spans, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts) -> Words:
    """Runs of ``[^\\x20\\x09-\\x0D]``, never across texts."""
    inside = ~_WHITE[texts.data]
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = texts.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, texts.at))


def word_hashes(texts: Texts, words: Words, table: int = 0) -> np.ndarray:
    return Spans(texts.data, table).hashes(words.start, words.end)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    m = max(0, len(hashes) - n + 1)
    total = np.zeros(m, np.uint64)
    for i, c in enumerate(constants(303 + n, n)):
        total += mixed(hashes[i : i + m] ^ c) * constants(404, i + 1)[-1]
    return mixed(total)


def shingles_of(texts: Texts, n: int, table: int = 0) -> tuple[np.ndarray, np.ndarray, Words]:
    """``(hash, text)`` of every n-word shingle; a text with fewer words has one of all its words.

    A text without words has none.
    """
    words = words_of(texts)
    hashes = word_hashes(texts, words, table)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    shingles = shingle_hashes(hashes, n)
    whole = owner[: len(shingles)] == owner[n - 1 :] if len(shingles) else np.zeros(0, bool)
    result, owners = shingles[whole], owner[: len(shingles)][whole]
    for i in np.flatnonzero((words.counts > 0) & (words.counts < n)):
        own = hashes[words.first[i] : words.first[i + 1]]
        one = shingle_hashes(own, len(own)) ^ _U(len(own))
        result, owners = np.append(result, one), np.append(owners, i)
    if len(owners) and (np.diff(owners) < 0).any():
        order = np.argsort(owners, kind="stable")
        result, owners = result[order], owners[order]
    return result, owners, words


def distinct_by_text(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, and where each text begins."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[keep], owners[keep]
    return hashes, np.searchsorted(owners, np.arange(n + 1))


class SortedHashes:
    """Distinct 64-bit hashes in ascending order, found through a directory of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.ascontiguousarray(hashes, np.uint64)
        bits = max(1, int(len(hashes)).bit_length() + 1)
        self._shift = _U(64 - bits)
        heads = (self.hashes >> self._shift).astype(np.int64)
        self._starts = np.searchsorted(heads, np.arange((1 << bits) + 1)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of every wanted hash, or -1."""
        result = np.full(len(wanted), -1, np.int32)
        if not len(self.hashes):
            return result
        head = (wanted >> self._shift).astype(np.int64)
        at, end = self._starts[head], self._starts[head + 1]
        equal = (self.hashes[np.minimum(at, len(self.hashes) - 1)] == wanted) & (at < end)
        np.copyto(result, at, where=equal)
        todo = np.flatnonzero(~equal & (at + 1 < end))
        at, end, wanted = at[todo] + 1, end[todo], wanted[todo]
        while len(todo):
            equal = self.hashes[at] == wanted
            result[todo[equal]] = at[equal]
            at = at + 1
            more = ~equal & (at < end)
            todo, at, end, wanted = todo[more], at[more], end[more], wanted[more]
        return result


def code_points(texts: Texts) -> Texts:
    """The characters of each text as 32-bit numbers; bytes that are no UTF-8 become U+FFFD."""
    whole = texts.data.tobytes()
    try:
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=begins[1:])
        return Texts(points, begins[texts.at])
    except UnicodeDecodeError:
        parts = [
            np.frombuffer(texts.text(i).decode(errors="replace").encode("utf-32-le"), np.uint32)
            for i in range(len(texts))
        ]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return Texts(np.concatenate([*parts, np.zeros(0, np.uint32)]), at.astype(np.int64))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n numbers from each position on."""
    m = max(0, len(points) - n + 1)
    total = np.zeros(m, np.uint64)
    for i, c in enumerate(constants(505 + n, n)):
        total += points[i : i + m] * c
    return mixed(total)
