"""Supervised subword embeddings: a linear softmax over averaged vectors of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphist.llm.texts import Texts, all_slices, code_points, gram_hashes, mixed, word_hashes, words_of

BUCKET_BITS = 18
DIM = 16
GRAM_SIZES = (3, 4)
EPOCHS = 8
RATE = 0.5
# Bound of the sample that the classifier is fitted on: labelled rows with the lowest hashed ids.
TRAIN_ROWS = 4_000

_U = np.uint64


def feature_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text)`` of every word and character n-gram, and of repeats of words.

    A word equal to one of the four before it also gives a feature named by the distance,
    which lets the model learn repetition without learning the words.
    """
    shift = _U(64 - BUCKET_BITS)
    words = words_of(texts)
    hashes = word_hashes(texts, words)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    buckets, owners = [(hashes >> shift)], [owner]
    for back in range(1, 5):
        same = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        name = mixed(np.array([back], np.uint64))[0] >> shift
        buckets.append(np.full(int(same.sum()), name, np.uint64))
        owners.append(owner[back:][same])
    points = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), points.sizes)
    for n in GRAM_SIZES:
        hashes = gram_hashes(points.data, n)
        inside = owner[: len(hashes)] == owner[n - 1 :] if len(hashes) else np.zeros(0, bool)
        buckets.append(hashes[inside] >> shift)
        owners.append(owner[: len(hashes)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def sparse_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text, their share of its features, and where each text begins."""
    buckets, owners = feature_buckets(texts)
    keys, counts = np.unique((owners << BUCKET_BITS) | buckets, return_counts=True)
    owner = keys >> BUCKET_BITS
    totals = np.maximum(1, np.bincount(owner, counts, len(texts)))
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    return (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), (counts / totals[owner]).astype(np.float32), begins


@dataclass
class SubwordClassifier:
    """Softmax of two classes over the mean embedding.

    For scoring, every bucket's vector times the output weights is one number, so a text's
    log odds are the mean of those numbers plus the bias.
    """

    embeddings: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def bucket_odds(self) -> np.ndarray:
        return self.embeddings @ (self.output[:, 1] - self.output[:, 0])

    @property
    def base_odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def fit(
    buckets: list[np.ndarray],
    shares: list[np.ndarray],
    labels: np.ndarray,
    dim: int = DIM,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 7,
) -> SubwordClassifier:
    """Stochastic gradient descent, a document at a time, with a rate that falls to 0."""
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    output = random.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(labels)), 0
    target = np.eye(2, dtype=np.float32)
    for _ in range(epochs):
        for i in random.permutation(len(labels)):
            own, share = buckets[i], shares[i]
            if not len(own):
                continue
            now = rate * (1 - done / steps)
            done += 1
            vectors = embeddings[own]
            mean = share @ vectors
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum() - target[labels[i]]
            back = output @ error
            output -= now * np.outer(mean, error)
            bias -= now * error
            # Scaled by the squared norm of the shares, so that long texts move as far as short ones.
            embeddings[own] = vectors - (now / float(share @ share)) * share[:, None] * back
    return SubwordClassifier(embeddings, output, bias)


def train_quality_model(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, dim: int = DIM, epochs: int = EPOCHS
) -> SubwordClassifier | None:
    """Fit on the texts of ``docs (doc_id, text)`` with a 0 or 1 in ``labels (doc_id, label)``.

    Only the ``rows`` labelled documents with the lowest hashed ids are fitted on, which bounds
    what is broadcast and what reaches the driver; features of their whole texts are made in
    the tasks. Of rows with the same id one is taken. None if no document has a label.
    """
    known = labels.filter("label IN (0, 1)").join(docs.select("doc_id"), "doc_id", "left_semi")
    order = known.select("doc_id", F.xxhash64("doc_id").alias("_h")).distinct().orderBy("_h", "doc_id")
    sample = order.limit(rows).select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"))
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in all_slices(batches):
            buckets, shares, begins = sparse_features(texts)
            offsets = pa.array(begins.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("label"),
                    pa.ListArray.from_arrays(offsets, pa.array(buckets)),
                    pa.ListArray.from_arrays(offsets, pa.array(shares)),
                ],
                ["doc_id", "label", "buckets", "shares"],
            )

    made = one.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(
        run, "doc_id long, label int, buckets array<int>, shares array<float>"
    )
    single = made.groupBy("doc_id").agg(F.min(F.struct("label", "buckets", "shares")).alias("r")).select("doc_id", "r.*")
    found = single.toArrow().sort_by("doc_id")
    if found.num_rows == 0:
        return None
    return fit(
        [x.values.to_numpy() for x in found["buckets"]],
        [x.values.to_numpy() for x in found["shares"]],
        found["label"].to_numpy(),
        dim,
        epochs,
    )


def quality_scores(
    docs: DataFrame, model: SubwordClassifier | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, score)`` for every row, in one pass without a shuffle.

    The score is the probability of label 1. Null, empty and wordless texts are scored by the
    bias alone, and every text by 0.5 without a model. Only the text is an input.
    """
    odds = model.bucket_odds().astype(np.float32) if model else np.zeros(1 << BUCKET_BITS, np.float32)
    base = model.base_odds if model else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in all_slices(batches):
            buckets, owners = feature_buckets(texts)
            n = np.bincount(owners, minlength=len(texts))
            mean = np.bincount(owners, odds[buckets], len(texts)) / np.maximum(n, 1)
            score = 1 / (1 + np.exp(-np.clip(mean + base, -700, 700)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
