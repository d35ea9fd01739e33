"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphist.llm.texts import SortedHashes, Texts, all_slices, code_points, gram_hashes
from glyphist.session import release, stored

ORDER = 4
# A task hands its counts on when it holds more n-grams than this.
TASK_GRAMS = 1_000_000
# Share of the training texts of a language that its limit of rejection lets pass.
REJECT_ABOVE = 0.999
# Scales of scores to choose from.
SCALES = np.geomspace(0.05, 20, 30)
# Shares of the rows, on either side of a quantile, that are looked at one by one.
QUANTILE_MARGIN = 0.001
UNDETERMINED = "und"

_PAD = 2
_LETTER = regex.compile(r"\p{L}")


def padded_points(texts: Texts, order: int = ORDER) -> Texts:
    """Lower-cased characters, each text after order - 1 padding marks."""
    lower = [texts.text(i).decode(errors="replace").lower().encode() for i in range(len(texts))]
    at = np.concatenate([[0], np.cumsum([len(t) for t in lower], dtype=np.int64)]).astype(np.int64)
    points = code_points(Texts(np.frombuffer(b"".join(lower), np.uint8), at))
    if len(points) == 0:
        return Texts(np.zeros(0, np.uint32), np.zeros(1, np.int64))
    shift = (order - 1) * np.arange(len(points) + 1)
    result = np.full(len(points.data) + shift[-1], _PAD, np.uint32)
    place = np.arange(len(points.data)) + np.repeat(shift[1:], points.sizes)
    result[place] = points.data
    return Texts(result, points.at + shift)


def text_grams(points: Texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """First position and text of every n-gram that lies in one text: one per character."""
    per_text = np.maximum(0, points.sizes - (order - 1))
    owner = np.repeat(np.arange(len(points)), per_text)
    before = np.concatenate([[0], np.cumsum(per_text)[:-1]]) if len(points) else np.zeros(0, np.int64)
    first = np.arange(len(owner)) - np.repeat(before, per_text) + points.at[:-1][owner]
    return first, owner


class GramCounter:
    """Counts of the n-grams of one language, merged slice by slice."""

    def __init__(self, order: int):
        self.order = order
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.grams = np.zeros((0, order), np.uint32)
        self._table: SortedHashes | None = None

    def add(self, points: Texts) -> None:
        first, _ = text_grams(points, self.order)
        hashes = gram_hashes(points.data, self.order)[first]
        if self._table is None or len(self._table) != len(self.hashes):
            self._table = SortedHashes(self.hashes)
        known = self._table.find(hashes)
        new = known < 0
        self.counts += np.bincount(known[~new], minlength=len(self.counts))
        if not new.any():
            return
        added, index, counts = np.unique(hashes[new], return_index=True, return_counts=True)
        at = first[new][index]
        merged = np.concatenate([self.hashes, added])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.grams = np.concatenate([self.grams, points.data[at[:, None] + np.arange(self.order)]])[order]


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n)`` over the whole texts of ``docs (lang, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, GramCounter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                data = np.ascontiguousarray(counter.grams, "<u4").tobytes()
                width = 4 * order
                grams = [data[i : i + width].decode("utf-32-le", "replace") for i in range(0, len(data), width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counter.counts)],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for part, texts in all_slices(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                pieces = [texts.data[texts.at[i] : texts.at[i + 1]] for i in own]
                at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                subset = Texts(np.concatenate(pieces), at)
                held.setdefault(lang, GramCounter(order)).add(padded_points(subset, order))
            if sum(len(c.hashes) for c in held.values()) > TASK_GRAMS:
                yield from rows()
        yield from rows()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class _Level:
    """All n-grams of one order in any language, with the log probability in each language.

    After the last row of ``log_p`` comes one of zeros, which index -1 finds.
    """

    table: SortedHashes
    log_p: np.ndarray


class KneserNey:
    """Models of several languages that share their hash arrays.

    For each order there is one sorted array of n-gram hashes; a row of ``log_p`` has the
    interpolated probability in every language, those that never saw the n-gram included.
    An n-gram of no language backs off to the next order with the weights of its context.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """``grams``: distinct n-grams as rows of characters; ``counts``: n-gram by language."""
        self.langs, self.order = langs, order
        n_langs = len(langs)
        # Continuation counts: how many different characters stand before the n-gram.
        levels = {order: (grams, counts.astype(np.float64))}
        for n in range(order - 1, 0, -1):
            longer, known = levels[n + 1]
            rows, inverse = np.unique(longer[:, 1:], axis=0, return_inverse=True)
            kinds = np.zeros((len(rows), n_langs))
            np.add.at(kinds, inverse.reshape(-1), (known > 0).astype(np.float64))
            levels[n] = (rows, kinds)
        self.levels: dict[int, _Level] = {}
        self.backoff: dict[int, _Level] = {}
        alphabet = len(levels[1][0]) + 1
        below = np.full((1, n_langs), 1.0 / alphabet)
        self.unseen = np.zeros(n_langs)
        for n in range(1, order + 1):
            rows, known = levels[n]
            once, twice = (known == 1).sum(axis=0), (known == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5)
            if n == 1:
                contexts, inverse = rows[:1, :0], np.zeros(len(rows), np.int64)
            else:
                contexts, inverse = np.unique(rows[:, :-1], axis=0, return_inverse=True)
                inverse = inverse.reshape(-1)
            total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, inverse, known)
            np.add.at(kinds, inverse, (known > 0).astype(np.float64))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                lower = np.broadcast_to(below, known.shape)
                self.unseen = np.log(weight[0] * below[0])
            else:
                lower_rows = self.levels[n - 1].table.find(_row_hashes(rows[:, 1:]))
                lower = np.exp(self.levels[n - 1].log_p[lower_rows])
                self.backoff[n] = _level(contexts, np.log(np.maximum(weight, 1e-12)))
            own = np.maximum(known - discount, 0) / np.maximum(total, 1)[inverse]
            self.levels[n] = _level(rows, np.log(own + weight[inverse] * lower))

    def log_probabilities(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log probability, in each language, of the last character of the n-grams at ``first``."""
        hashes = gram_hashes(points, self.order)[first]
        found = self.levels[self.order].table.find(hashes)
        result = self.levels[self.order].log_p[found]  # the row at -1 is 0
        todo = np.flatnonzero(found < 0)
        for n in range(self.order - 1, 0, -1):
            if not len(todo):
                return result
            at = first[todo] + (self.order - 1 - n)
            context = self.backoff[n + 1].table.find(_window_hashes(points, at, n))
            result[todo] += self.backoff[n + 1].log_p[context]
            found = self.levels[n].table.find(_window_hashes(points, at + 1, n))
            result[todo] += self.levels[n].log_p[found]
            todo = todo[found < 0]
        result[todo] += self.unseen.astype(np.float32)
        return result

    def entropies(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text in every language, and its characters."""
        points = padded_points(texts, self.order)
        first, _ = text_grams(points, self.order)
        n = np.maximum(0, points.sizes - (self.order - 1))
        sums = np.zeros((len(texts), len(self.langs)))
        filled = np.flatnonzero(n)
        if len(filled):
            begins = np.concatenate([[0], np.cumsum(n[filled])[:-1]])
            sums[filled] = np.add.reduceat(self.log_probabilities(points.data, first), begins, axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    width = rows.shape[1]
    flat = np.ascontiguousarray(rows).reshape(-1)
    return gram_hashes(flat, width)[::width] if len(flat) else np.zeros(0, np.uint64)


def _window_hashes(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return _row_hashes(points[at[:, None] + np.arange(n)])


def _level(rows: np.ndarray, values: np.ndarray) -> _Level:
    hashes = _row_hashes(rows)
    order = np.argsort(hashes)
    ordered = np.concatenate([values[order], np.zeros((1, values.shape[1]))])
    return _Level(SortedHashes(hashes[order]), ordered.astype(np.float32))


@dataclass
class LanguageModel:
    """The character models with the scale of their scores and the limits of rejection."""

    model: KneserNey | None
    scale: float = 1.0
    limits: np.ndarray | None = None

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(lang, score, rejected)`` of every text; ``und`` with score 0 if it has no letter."""
        n = len(texts)
        lang, score, rejected = np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n, bool)
        if self.model is None or not n:
            return lang, score, rejected
        letters = np.array([bool(_LETTER.search(texts.text(i).decode(errors="replace"))) for i in range(n)])
        entropy, length = self.model.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(n), best]
        share = 1 / np.exp(-posterior_exponent(entropy, length, self.scale)).sum(axis=1)
        lang[letters] = np.array(self.model.langs, object)[best[letters]]
        score[letters] = share[letters]
        rejected[letters] = lowest[letters] > self.limits[best[letters]]
        return lang, score, rejected


def posterior_exponent(entropy: np.ndarray, length: np.ndarray, scale: float) -> np.ndarray:
    """How much worse than the best each language is, scaled to calibrated log odds."""
    worse = entropy - entropy.min(axis=1, keepdims=True)
    return np.minimum(scale * np.sqrt(length)[:, None] * worse, 700)


def train_language_model(
    training: DataFrame,
    order: int = ORDER,
    calibration_rows: int | None = None,
    reject_above: float = REJECT_ABOVE,
) -> LanguageModel:
    """Fit on all rows of ``training (doc_id, lang, text)``, all with a lang and a text.

    Every text is counted, and the model keeps every n-gram of every language: discounts,
    continuation counts and context totals rest on all of them. One row per language and
    distinct n-gram reaches the driver, and a table of distinct n-grams by languages the
    tasks. The scale of scores and the limits of rejection come from all texts too, unless the
    caller asks for ``calibration_rows`` with the lowest hashed ids.
    """
    counts = gram_counts(training, order).toArrow()
    if counts.num_rows == 0:
        return LanguageModel(None)
    langs = sorted(set(counts["lang"].to_pylist()))
    index = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([index[x] for x in counts["lang"].to_pylist()])
    joined = "".join(counts["gram"].to_pylist())
    rows = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, order)
    rows, inverse = np.unique(rows, axis=0, return_inverse=True)
    table = np.zeros((len(rows), len(langs)), np.int64)
    table[inverse.reshape(-1), lang] = counts["n"].to_numpy()
    model = KneserNey(langs, rows, table, order)

    if calibration_rows is not None:
        limit = training.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id")
        ids = limit.limit(calibration_rows).select("doc_id").distinct()
        training = training.join(F.broadcast(ids), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in all_slices(batches):
            entropy, length = model.entropies(texts)
            own = np.flatnonzero(length > 0)
            true = np.array([index[x] for x in part.column("lang").to_pylist()], np.int64)[own]
            entropy, length, at = entropy[own], length[own], np.arange(len(own))
            losses = []
            for scale in SCALES:
                exponent = posterior_exponent(entropy, length, scale)
                losses.append(float((exponent[at, true] + np.log(np.exp(-exponent).sum(axis=1))).sum()))
            # A row per text, and one for the losses of all of them.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(langs[i] for i in true), None], pa.string()),
                    pa.array([*entropy[at, true].tolist(), None], pa.float64()),
                    pa.array([None] * len(own) + [losses], pa.list_(pa.float64())),
                ],
                ["lang", "entropy", "losses"],
            )

    seen = training.select("lang", "text").mapInArrow(run, "lang string, entropy double, losses array<double>")
    seen = stored(seen, "calibration")
    try:
        sums = seen.agg(*[F.sum(F.get("losses", F.lit(i))) for i in range(len(SCALES))]).first()
        found = quantiles(seen.filter(F.col("lang").isNotNull()), "lang", "entropy", reject_above)
    finally:
        release(seen)
    best = float(SCALES[int(np.argmin(sums))]) if found else 1.0
    return LanguageModel(model, best, np.array([found.get(x, np.inf) for x in langs]))


def quantiles(rows: DataFrame, key: str, value: str, share: float, margin: float = QUANTILE_MARGIN) -> dict[str, float]:
    """The exact quantile of the values of every key, between two of them by their distance.

    A sketch gives two values around it; the rows below them are counted, and only the distinct
    values between them, about twice ``margin`` of the rows, reach the driver.
    """
    ends = [max(0.0, share - margin), min(1.0, share + margin)]
    around = F.percentile_approx(value, ends, 100_000)
    bounds = rows.groupBy(key).agg(F.count(value).alias("n"), around.alias("ends"))
    counts = {r[key]: (r.n, *r.ends) for r in bounds.collect()}
    if not counts:
        return {}
    limits = rows.sparkSession.createDataFrame([(k, *x[1:]) for k, x in counts.items()], f"{key} string, low double, high double")
    near = rows.filter(F.col(value).isNotNull()).join(F.broadcast(limits), key).filter(F.col(value) <= F.col("high"))
    place = F.when(F.col(value) >= F.col("low"), F.col(value))
    band: dict[str, list[tuple[float, int]]] = {k: [] for k in counts}
    below = dict.fromkeys(counts, 0)
    for k, v, n in near.groupBy(key, place.alias("v")).agg(F.count("*").alias("n")).collect():
        if v is None:
            below[k] = n
        else:
            band[k].append((v, n))
    result = {}
    for k, (n, *_) in counts.items():
        values, times = map(np.array, zip(*sorted(band[k])))
        rank = (n - 1) * share
        ranks = np.array([int(rank), min(int(rank) + 1, n - 1)])
        last = below[k] + np.cumsum(times)
        if ranks[0] < below[k] or ranks[1] >= last[-1]:
            return quantiles(rows, key, value, share, 10 * margin)
        low, high = values[np.searchsorted(last, ranks, "right")].tolist()
        result[k] = low + (rank - int(rank)) * (high - low)
    return result


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, in one pass without a shuffle.

    ``lang_pred`` is the language with the lowest cross-entropy per character, the first by
    name on a tie; ``und`` with score 0 if the text is null, empty or has no letter, or the
    model saw no text. ``rejected`` marks those and texts less likely, in the best language,
    than nearly all texts it was calibrated on. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in all_slices(batches):
            lang, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


