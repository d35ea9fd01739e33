"""Packing of token sequences into as few fixed-size sequences as possible.

The pieces are integers from 1 to the capacity, so a packing is a list of fillings: a
multiset of piece sizes and how often it is used. It is found from the counts of each
size, a table of at most ``capacity`` rows whatever the corpus, and applied to the pieces
by their rank among those of their size.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphist.llm.token_counts import byte_letters, word_cutter
from glyphist.session import stored

CAPACITY = 1024
END_ID = 2
# Parts, and words, whose ids a task keeps: a half of them is dropped when there are more.
CACHED_PIECES = 400_000
# Limits of the search for better fillings; the best found so far is always whole.
SEARCH_NODES = 200
FILLINGS_PER_NODE = 20_000
BRANCHES = 4

# Fixed value: how this vocabulary cuts text before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A text is cut at single spaces. A cut-off part with the space before it gives the same
    ids alone as in the text, unless it ends in white space or is empty; texts with such
    parts, or with a special string, go through the tokenizer as a whole.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._letters = {i: c for i, c in enumerate(byte_letters())}
        self._find = word_cutter(WORD_PATTERN)
        # Two generations each: when the newer one is half of what may be held, the older goes.
        self._parts: dict[str, bytes | None] = {}
        self._old_parts: dict[str, bytes | None] = {}
        self._words: dict[str, bytes] = {}
        self._old_words: dict[str, bytes] = {}
        self._half = cached // 2

    def _new(self, word: str) -> bytes:
        if word[0] == " " and word.isascii() and word[1:].isalpha():
            letters = self._letters[ord(" ")] + word[1:]  # other ASCII letters stand for themselves
        else:
            letters = word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._words.get(word)
        if ids is None:
            ids = self._old_words.get(word)
            if ids is None:
                ids = self._new(word)
            if len(self._words) > self._half:
                self._words, self._old_words = {}, self._words
            self._words[word] = ids
        return ids

    def _alone(self, part: str) -> bytes:
        """Ids of letters after a space, made once whether a mark follows or not."""
        ids = self._parts.get(part)
        if ids is None:
            ids = self._old_parts.get(part)
            if ids is None:
                ids = self._new(" " + part)
            self._parts[part] = ids
        return ids

    def _part(self, part: str) -> bytes | None:
        # Letters alone, or before one mark, are cut as the pattern cuts them.
        if part.isalpha():
            return self._alone(part)
        if part[:-1].isalpha() and part[-1] in ".,;:!?":
            return self._alone(part[:-1]) + self._word(part[-1])
        if not part or part[-1].isspace():
            return None
        return b"".join(map(self._word, self._find(" " + part)))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        special = any(s in text for s in self._special)
        if not special and not (first and first[-1].isspace()):
            if len(self._parts) > self._half:
                self._parts, self._old_parts = {}, self._parts
            known, old = self._parts, self._old_parts
            for part in set(parts).difference(known):
                known[part] = old[part] if part in old else self._part(part)
            try:
                rest = b"".join(map(known.__getitem__, parts))
            except TypeError:  # a part that is None
                rest = None
            if rest is not None:
                return b"".join(map(self._word, self._find(first))) + rest
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents of at most ``capacity`` tokens
    whole, longer ones as a first piece with the remainder and pieces of ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextIds(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encoder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                start, length = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(own)))
                    start, length = start + length, capacity
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Filling = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by the sum, and by pieces too large to share one."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for small in range(1, capacity // 2 + 1):
        if small not in counts and small != 1:
            continue
        large = sum(n for s, n in counts.items() if s > capacity - small)
        middle = sum(n for s, n in counts.items() if capacity // 2 < s <= capacity - small)
        rest = sum(s * n for s, n in counts.items() if small <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in counts.items() if capacity // 2 < s <= capacity - small)
        best = max(best, large + middle + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on counts: the first incumbent.

    Each largest piece is completed by the largest that still fits, and the filling is
    used as often as the counts allow, which uses up at least one size each time.
    """
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left, reverse=True)
    fillings: list[Filling] = []
    while sizes:
        filling, room = [], capacity
        for size in sizes:
            take = min(left[size], room // size)
            filling += [size] * take
            room -= take * size
            if room < sizes[-1]:
                break
        times = min(left[s] // filling.count(s) for s in set(filling))
        for s in set(filling):
            left[s] -= times * filling.count(s)
        sizes = [s for s in sizes if left[s]]
        fillings.append((tuple(filling), times))
    return fillings


def completions(left: dict[int, int], sizes: list[int], room: int, limit: int = FILLINGS_PER_NODE) -> list[tuple]:
    """Fillings of ``room`` that no other dominates, fullest first.

    ``sizes`` descends. A filling is dominated if a piece left out fits in place of one
    that is in, so at least the room it leaves is below every left-out piece, and no
    left-out piece lies between a member and that member plus the room left.
    """
    found: list[tuple[int, tuple]] = []
    steps = 0
    suffix_total = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        suffix_total[i] = suffix_total[i + 1] + sizes[i] * left[sizes[i]]
    best_waste = room
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and steps < limit:
        steps += 1
        i, free, chosen = stack.pop()
        while i < len(sizes) and sizes[i] > free:
            i += 1
        if i == len(sizes) or free == 0:
            used = dict.fromkeys(chosen, 0)
            for s in chosen:
                used[s] += 1
            for s in chosen:
                if any(s < x <= s + free and left[x] > used.get(x, 0) for x in range(s + 1, s + free + 1) if x in left):
                    break
            else:
                found.append((free, chosen))
                best_waste = min(best_waste, free)
            if best_waste == 0 and len(found) >= BRANCHES:
                break
            continue
        if free - suffix_total[i] > best_waste:
            continue  # even all that is left wastes more than a filling already found
        size = sizes[i]
        most = min(left[size], free // size)
        for take in range(0, most + 1):
            stack.append((i + 1, free - take * size, chosen + (size,) * take))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in found]


def _fullest(left: dict[int, int], sizes: list[int], room: int) -> tuple[int, ...]:
    """The best-fit filling: each time the largest piece that fits. For nodes too wide to enumerate."""
    filling: list[int] = []
    for size in sizes:
        take = min(left[size], room // size)
        filling += [size] * take
        room -= take * size
    return tuple(filling)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> list[Filling]:
    """Branch and bound: the largest piece left gets a completion, the rest is searched on.

    A branch ends when the waste so far leaves no room below the incumbent. The search
    visits at most ``nodes`` complete descents after the first; the best packing found
    is returned, and it stops at once if the lower bound is met. Of a node's fillings, found
    in at most ``FILLINGS_PER_NODE`` steps, the ``BRANCHES`` fullest are followed; a node with
    none in that time is completed by best fit.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_used = sum(t for _, t in best)

    # A state: what is left, the fillings so far, their number and waste.
    stack = [(counts, (), 0, 0)]
    descents = 0
    while stack and best_used > least and descents < nodes:
        left, so_far, used, waste = stack.pop()
        if not left:
            descents += 1
            if used < best_used:
                fillings, node = [], so_far
                while node:
                    filling, node = node
                    fillings.append(filling)
                best, best_used = fillings[::-1], used
            continue
        # Sequences needed in the end: all tokens and all waste so far, rounded up.
        if -(-(total + waste) // capacity) >= best_used:
            descents += 1
            continue
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        sizes = sorted((s for s, n in rest.items() if n), reverse=True)
        room = capacity - largest
        options = completions(rest, sizes, room)[:BRANCHES] or [_fullest(rest, sizes, room)]
        children = []
        for option in options:
            filling = (largest, *option)
            times = min(left[s] // filling.count(s) for s in set(filling))
            child = dict(left)
            for s in set(filling):
                child[s] -= times * filling.count(s)
            child = {s: n for s, n in child.items() if n}
            spare = (capacity - sum(filling)) * times
            children.append((child, ((filling, times), so_far), used + times, waste + spare))
        stack += children[::-1]
        if len(stack) > 4 * nodes:
            descents += 1
    return best


def slots_of(fillings: list[Filling]) -> list[tuple[int, int, int, int, int]]:
    """``(length, rank_from, rank_to, first_sequence, offset)`` of every place in the fillings.

    Pieces of one length with ranks from ``rank_from`` to before ``rank_to`` stand at
    ``offset`` of the sequences from ``first_sequence`` on, one in each.
    """
    taken: dict[int, int] = {}
    rows, first = [], 0
    for filling, times in fillings:
        offset = 0
        for size in filling:
            rank = taken.get(size, 0)
            rows.append((size, rank, rank + times, first, offset))
            taken[size] = rank + times
            offset += size
        first += times
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with a ``length``.

    Pieces are ranked within their length by (document, piece): ranges of the order over
    all pieces are counted, and each range numbers its own rows, so a length shared by most
    pieces is no burden for one task. Only counts per length (at most ``capacity``) and
    the places in the fillings (at most ``capacity`` fillings) reach the driver.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "doc_id", "piece", "ids_crc32", "_row"]
    # Range bounds come from a sample: written, so that all later steps see the same parts.
    ranged = stored(
        pieces.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order)
        .withColumn("_part", F.spark_partition_id()),
        "packing",
    )
    counts = ranged.groupBy("_part", "length").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots_of(bin_completion(by_length, capacity, nodes))
    # Full sequences and repeated fillings take one row each, so there are few places.
    table = spark.createDataFrame(places, "length long, rank_from long, rank_to long, first_sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part and length: the parts follow the order by length.
    starts = counts.select(
        "_part", F.col("length").alias("_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("_part", "length").orderBy(*order[1:])
    ranked = (
        ranged.withColumn("_within", F.row_number().over(within) - 1)
        .join(F.broadcast(starts.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_length")))
        .withColumn("_rank", F.col("_start") + F.col("_within"))
    )
    # Places of a length ascend, so a piece's place is found in an array, without a range join.
    lists = table.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "first_sequence", "offset"))).alias("_places")
    )
    found = F.filter(
        "_places", lambda p: (p["rank_from"] <= F.col("_rank")) & (F.col("_rank") < p["rank_to"])
    )
    placed = ranked.join(F.broadcast(lists), "length").withColumn("_place", F.get(found, F.lit(0)))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_place.first_sequence") + F.col("_rank") - F.col("_place.rank_from")).alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: its document, tokens and place in a sequence of ``capacity`` tokens.

    A null or empty text is the end id alone, one piece of one token. Repeated rows are
    packed once each; an empty table gives no rows. Columns of ``docs`` other than id and
    text are not read. The tokenizer file must lie at the same path on every machine.
    """
    return packed(stored(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
