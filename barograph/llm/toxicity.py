"""Toxicity by multiple-instance learning.

A document is a bag of sentences (pieces of at most PIECE words). A sentence's logit is a bias plus the weights of its
words and of the words' first bytes (a sentence without any that has a weight counts as clean); a document is toxic if any of its sentences is: P = 1 - prod(1 - p), the noisy-or.
Only documents are labelled; the gradient of the noisy-or shares a label out among the sentences, so the weights also
locate the sentences that made a document toxic. Words and their beginnings are hashed to BUCKETS weights.

The model is fitted on at most MAX_DOCS labelled documents, chosen by a hash of doc_id; scoring covers every text.
Texts that are null or have no words have no sentences and score 0. Texts are whole, however long. Repeated rows have equal
scores; a score equal to the threshold counts as toxic. Null labels and labels without a document are left out; of several
labels for a document, or for equal texts, the highest counts. Without labels of both kinds every score is 0. Columns
that are not asked for are dropped by ``score`` and kept by ``reject``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import kernels

BUCKETS = 1 << 18
#: Lengths in bytes of the beginnings of words that count besides the word.
HEADS = (4, 5, 6)
PIECE = 32
#: Bound of the documents that the model is fitted on.
MAX_DOCS = 20_000
#: A feature has a weight if it occurs in LEAST_DOCS of them and tells toxic from other ones by LEAST_Z deviations.
LEAST_DOCS, LEAST_Z = 4, 5.5
EPOCHS, BATCH, RATE, DECAY = 16, 128, 0.3, 1e-3
THRESHOLD = 0.7
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


class Bags(NamedTuple):
    """Features by word (one row each), words by sentence and sentences by document."""

    features: np.ndarray
    sentence_first: np.ndarray
    doc_first: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def bags(texts: kernels.Bytes) -> Bags:
    w = kernels.words(texts)
    n_docs = len(w.first) - 1
    if not len(w.hashes):
        return Bags(np.zeros((0, 1 + len(HEADS)), np.int32), np.zeros(1, np.int64), np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lower = kernels.lowered(texts.data)
    mask = np.uint64(BUCKETS - 1)
    columns = [w.hashes & mask]
    for n in HEADS:
        cut = np.minimum(w.starts + n, w.ends)
        columns.append(kernels.mix(kernels.range_hashes(lower, w.starts, cut) + np.uint64(n)) & mask)
    owner = w.owner()
    # A new sentence where a stop, or another text, stands between two words; then pieces of PIECE words.
    stops = np.flatnonzero(_STOPS[texts.data])
    near = np.searchsorted(stops, w.starts)
    new = np.ones(len(near), dtype=bool)
    new[1:] = (near[1:] != near[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(near))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    first = np.flatnonzero(new | (since % PIECE == 0))
    last = np.append(first[1:], len(near)) - 1
    base = texts.offsets[owner[first]]
    return Bags(np.stack(columns, axis=1).astype(np.int32), np.append(first, len(near)), np.searchsorted(first, w.first), w.starts[first] - base, w.ends[last] - base)


def pairs(b: Bags, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) of the wanted features, each once a sentence, in order."""
    word, column = np.nonzero(wanted[b.features])
    sentence = np.searchsorted(b.sentence_first, word, side="right") - 1
    return np.divmod(np.unique(sentence * np.int64(BUCKETS) + b.features[word, column]), BUCKETS)


def noisy_or(logits: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the sentences, and of the documents."""
    p = np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(logits, -30, 30))))
    sums = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return p, -np.expm1(sums[doc_first[1:]] - sums[doc_first[:-1]])


def logits(sentence: np.ndarray, weight: np.ndarray, n: int, bias: float) -> np.ndarray:
    """Of n sentences, from the weights of their features. One without a feature that has a weight is no evidence, so that
    a document is not toxic for being long."""
    known = np.bincount(sentence, minlength=n)[:n] > 0
    return np.where(known, np.bincount(sentence, weight, n)[:n] + bias, -np.inf)


def probabilities(b: Bags, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the sentences, and of the documents."""
    n = len(b.sentence_first) - 1
    if np.isneginf(bias):  # nothing was learnt
        return np.zeros(n), np.zeros(len(b.doc_first) - 1)
    sentence, feature = pairs(b, weights != 0)
    return noisy_or(logits(sentence, weights[feature], n, bias), b.doc_first)


def _telling(parts: list[Bags], labels: np.ndarray) -> np.ndarray:
    """Features whose share of toxic documents lies LEAST_Z deviations off the share of all."""
    counts = np.zeros((2, BUCKETS))
    at = 0
    for part in parts:
        n = len(part.doc_first) - 1
        doc_of = np.repeat(np.repeat(np.arange(n), np.diff(part.doc_first)), np.diff(part.sentence_first))
        both = np.unique(doc_of[:, None] * np.int64(BUCKETS) + part.features)
        doc, feature = np.divmod(both, BUCKETS)
        for y in (0, 1):
            counts[y] += np.bincount(feature[labels[at + doc] == y], minlength=BUCKETS)
        at += n
    n, share = counts.sum(axis=0), labels.mean()
    return (n >= LEAST_DOCS) & (np.abs(counts[1] - n * share) >= LEAST_Z * np.sqrt(np.maximum(n, 1) * share * (1 - share)))


def fit(parts: list[Bags], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias, by AdaGrad on the noisy-or's log-likelihood."""
    if not len(labels) or not 0 < labels.sum() < len(labels):
        return np.zeros(BUCKETS), -np.inf
    telling = _telling(parts, labels)
    weights, bias = np.zeros(BUCKETS), -4.0
    squares, bias_square = np.ones(BUCKETS), 1.0
    batches, at = [], 0
    for part in parts:
        sentence, feature = pairs(part, telling)
        for d0 in range(0, len(part.doc_first) - 1, BATCH):
            d1 = min(d0 + BATCH, len(part.doc_first) - 1)
            first = part.doc_first[d0 : d1 + 1]
            lo, hi = np.searchsorted(sentence, [first[0], first[-1]])
            batches.append((sentence[lo:hi] - first[0], feature[lo:hi], first - first[0], labels[at + d0 : at + d1]))
        at += len(part.doc_first) - 1
    for _ in range(EPOCHS):
        for sentence, feature, first, y in batches:
            n = int(first[-1])
            p, whole = noisy_or(logits(sentence, weights[feature], n, bias), first)
            share = np.where(y == 1, -(1 - whole) / np.maximum(whole, 1e-6), 1.0)
            g = np.repeat(share, np.diff(first)) * p
            grad = np.bincount(feature, g[sentence], BUCKETS) + DECAY * weights
            squares += grad * grad
            weights -= RATE * grad / np.sqrt(squares)
            bias_square += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(bias_square)
    return weights, bias


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernels.release()
    parts, labels = [], []
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            parts.append(bags(kernels.text_bytes(part.column("text"))))
            labels += part.column("toxic").to_pylist()
    weights, bias = fit(parts, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


class Model(NamedTuple):
    weights: bytes
    bias: float


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fits on at most ``max_docs`` rows of ``labels`` (doc_id, toxic) and their texts, in one task of that bounded size."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_docs rows at most
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))  # copies would pass for evidence
    one = rows.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text").mapInArrow(_fit, "weights binary, bias double").first()
    return Model(bytes(one["weights"]), one["bias"]) if one else Model(np.zeros(BUCKETS, "<f4").tobytes(), -np.inf)


_OFFENDING = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(model: Model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        weights = np.frombuffer(model.weights, "<f4").astype(np.float64)
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                b = bags(kernels.text_bytes(part.column("text")))
                p, whole = probabilities(b, weights, model.bias)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for s in np.flatnonzero(p >= 0.5).tolist():
                    d = int(np.searchsorted(b.doc_first, s, side="right")) - 1
                    found[d].append({"start": int(b.begins[s]), "end": int(b.ends[s]), "score": float(p[s])})
                score = np.round(np.clip(whole, 0, 1), 9)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(score), pa.array(found, _OFFENDING)], [*kept, "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, ``score``, and ``offending``: byte ranges of the sentences of 0.5 or more."""
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(_score(model, keep), f"{fields}score double, offending array<struct<start: bigint, end: bigint, score: double>>")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score less than the threshold."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # a column may be called like a result
    at = docs.columns.index("text")
    rows = docs.toDF(*names).withColumnRenamed(names[at], "text")
    kept = ["text" if i == at else c for i, c in enumerate(names)]
    return score(rows, model, kept).where(F.col("score") < threshold).select(*kept).toDF(*docs.columns)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold() != 1).select("doc_id", "toxic")
