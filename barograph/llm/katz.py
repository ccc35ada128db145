"""Scoring of texts by a Katz backoff model of words and their predecessors.

Tokens of a text are its words, A-Z as a-z, then one end; before the first one stands a begin. Counts are discounted by
Good-Turing up to DISCOUNTED occurrences; where counts of counts give no valid discounts, as copies in a corpus may
cause, they are smoothed by a line in logarithms, and where that falls too slowly all lose the same amount. A word after a context it was seen with has its discounted share of the context's tokens; what the
discounts leave is shared among all other words in proportion to their unigram probabilities, so each context's
probabilities, with one unknown word, sum to 1. A context that nothing is left for counts one token more.

    log p(w | h) = log p(w) + log alpha(h) + delta(h, w)

with delta 0 for pairs not seen and alpha 1 for contexts not seen; p(w) of a word not seen is the unigrams' leftover. So
a text's score is a sum over its words, of what a word gives by itself and as a context, and one over its pairs that are
in the table of deltas: each level is looked up once for each distinct key of a slice of texts.

Work moves in blobs: a slice of texts sends, for each bucket of the hashed keys, one row with its distinct keys, so a
hot word or pair is one entry a slice. Tables are stored by bucket as well. Words with at least 1 / HOT_SHARE of all tokens, at most
HOT_SHARE of them, travel with the tasks, and the pairs they are in are dealt by both words. Contexts are taken in ROUNDS
parts, one after the other, so that shuffles need a part of the disk. Keys are 64-bit hashes.

A null text is empty and has the end alone; rows of a null doc_id are learnt from. Repeated rows have equal results, each
its own. Texts are whole, however long: longer ones come in pieces. Without anything to learn from the unknown word has
probability 1. Columns beside doc_id and text are dropped, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import kernels, pieces
from barograph.sources.tables import discard, workspace, write_shared

#: Counts up to this one are discounted, as Katz has it.
DISCOUNTED = 5
ROUNDS = 3
HOT_SHARE = 1 << 16
#: Tokens for each bucket, buckets at least, and bytes of text for each slice. A slice sends a row for each bucket.
BUCKET_TOKENS, LEAST_BUCKETS, SLICE = 1 << 21, 64, 1 << 21
_GOLD = np.uint64(0x9E3779B97F4A7C15)
BEGIN, END = (kernels.mix(np.array([x], np.uint64))[0] for x in (0xBE61, 0xE4D))

BLOB = "bucket bigint, kind int, id bigint, a binary, b binary, c binary, d binary"
_BLOB = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), *[(x, pa.binary()) for x in "abcd"]])
_WORDS, _TYPES, _HOT_TYPES, _COUNTS, _PAIRS, _CONTEXTS, _HEAD, _ASKED, _SUMS = range(9)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a word after a context."""
    return kernels.mix(kernels.mix(context) + word * _GOLD)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Slice(NamedTuple):
    """Tokens of some rows of a batch with what stands before each, and whose they are; ``last``: the rows end here."""

    begin: int
    end: int
    tokens: np.ndarray
    contexts: np.ndarray
    owner: np.ndarray
    number: int
    last: bool


def _hashes(texts: kernels.Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the index of each text's first."""
    starts, ends = kernels.spaced_words(texts) if len(texts.data) else (np.zeros(0, np.int64),) * 2
    return kernels.range_hashes(kernels.lowered(texts.data), starts, ends), np.searchsorted(starts, texts.offsets)


def _number(batch: pa.RecordBatch) -> int:
    """Stands for the rows of a slice, whatever task reads them."""
    h = hashlib.blake2b(digest_size=8)
    for column in (batch.column("doc_id"), batch.column("text")):
        data = kernels.text_bytes(column.cast(pa.string()))
        h.update(data.offsets.tobytes())
        h.update(column.is_null().to_numpy(zero_copy_only=False).tobytes())
        h.update(data.data)
    return int.from_bytes(h.digest(), "little", signed=True)


def token_slices(batch: pa.RecordBatch, numbered: bool = False) -> Iterator[Slice]:
    for begin, end, texts in pieces.slices(batch, "text", SLICE):
        number = _number(batch.slice(begin, end - begin)) if numbered else 0
        before, now = BEGIN, next(texts, None)
        while now is not None:
            after = next(texts, None)
            hashes, first = _hashes(now)
            n_texts, last = len(first) - 1, after is None
            sizes = np.diff(first) + last
            owner = np.repeat(np.arange(n_texts), sizes)
            starts = np.cumsum(sizes) - sizes
            tokens = np.full(len(owner), END)
            tokens[np.arange(len(hashes)) + np.repeat(np.arange(n_texts), np.diff(first)) * last] = hashes
            contexts = np.empty_like(tokens)
            contexts[1:] = tokens[:-1]
            contexts[starts[sizes > 0]] = before
            yield Slice(begin, end, tokens, contexts, owner, number, last)
            before = tokens[-1] if len(tokens) else before
            now = after


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOB, strict=True)], schema=_BLOB)


def _deal(bucket: np.ndarray, kind: int, number: int, *columns: np.ndarray) -> list[tuple]:
    """A row for each bucket, with its part of the columns."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = (None,) * (4 - len(columns))
    return [(int(bucket[a]), kind, number, *[c[a:b].tobytes() for c in columns], *rest) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and where each key stands first."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], order[at]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the ascending ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    yield from groupby(_rows(batches), key=lambda r: r[0])


def _array(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _read(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(BLOB).parquet(*paths).select(*_BLOB.names)  # a column with folders of its own would come last


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches by bytes, as rows are large here; shuffle files of written tables are not kept."""
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    had = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Discount(NamedTuple):
    """Factors for counts up to DISCOUNTED (index 0 is not used)."""

    factors: tuple[float, ...]

    @classmethod
    def of(cls, n: list[int]) -> Discount:
        """From counts of counts: n[r] keys occur r times, r from 1 to DISCOUNTED + 1."""
        k = DISCOUNTED
        if all(n[r] > 0 for r in range(1, k + 2)):
            common = (k + 1) * n[k + 1] / n[1]
            factors = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)]
            if all(0 < d < 1 for d in factors):
                return cls((1.0, *factors))
        # A line through the logarithms; below -1 its slope always gives valid discounts.
        known = [r for r in range(1, k + 2) if n[r] > 0]
        if len(known) > 1:
            x, y = np.log(known), np.log([n[r] for r in known])
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
            if slope < -1:
                common = (k + 1) ** (1 + slope)
                return cls((1.0, *[(((r + 1) / r) ** (1 + slope) - common) / (1 - common) for r in range(1, k + 1)]))
        lost = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return cls((1.0, *[(r - lost) / r for r in range(1, k + 1)]))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """The counts after discounting."""
        return np.append(self.factors, 1.0)[np.minimum(counts, DISCOUNTED + 1)] * counts


class Unigrams(NamedTuple):
    """Numbers that all tasks need: tokens, distinct tokens, discount, one token more or none, the unknown word's probability, hot words, buckets."""

    tokens: int
    types: int
    discount: Discount
    more: int
    unknown: float
    hot: np.ndarray
    hot_counts: np.ndarray
    buckets: int

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount.kept(counts) / max(1, self.tokens + self.more), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return find(self.hot, words)[1]


class Model(NamedTuple):
    unigrams: Unigrams
    words: str
    rounds: list[str]
    hot_alphas: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in token_slices(batch):
            words, counts, _ = _summed(s.tokens, np.ones(len(s.tokens), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


def _words_dealt(u: Unigrams):
    """The words that are not hot, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            cold = ~u.is_hot(words)
            yield _blobs(_deal(bucket_of(words[cold], u.buckets), _WORDS, 0, words[cold], counts[cold]))

    return run


def _pairs_dealt(u: Unigrams, r: int):
    """Distinct pairs of each slice whose context is of round r, by the bucket of the word, or of the pair if the word is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in token_slices(batch):
                own = s.contexts % np.uint64(ROUNDS) == r
                contexts, tokens = s.contexts[own], s.tokens[own]
                keys, counts, at = _summed(pair(contexts, tokens), np.ones(len(tokens), np.int64))
                contexts, tokens = contexts[at], tokens[at]
                yield _blobs(_deal(bucket_of(np.where(u.is_hot(tokens), keys, tokens), u.buckets), _TYPES, 0, contexts, tokens, counts.astype(np.uint32)))

    return run


def _read_words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words, counts = _array([x[3] for x in rows], np.uint64), _array([x[4] for x in rows], np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def _counts_of(u: Unigrams, words: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Occurrences of ``wanted``, from the hot words and the bucket's words."""
    out = np.zeros(len(wanted), np.int64)
    for keys, values in ((u.hot, u.hot_counts), (words, counts)):
        at, there = find(keys, wanted)
        out[there] = values[at[there]]
    return out


def _pair_types(u: Unigrams):
    """Distinct pairs with their counts and their words' counts, by the bucket of the context, and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(DISCOUNTED + 2, np.int64)
        for _, rows in _by_bucket(batches):
            own = list(rows)
            words = _read_words([x for x in own if x[1] == _WORDS])
            own = [x for x in own if x[1] == _TYPES]
            contexts, tokens = _array([x[3] for x in own], np.uint64), _array([x[4] for x in own], np.uint64)
            keys, counts, at = _summed(pair(contexts, tokens), _array([x[5] for x in own], np.uint32).astype(np.int64))
            contexts, tokens = contexts[at], tokens[at]
            n += np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
            word_counts = _counts_of(u, *words, tokens)
            hot = u.is_hot(contexts)
            for kind, part in ((_TYPES, ~hot), (_HOT_TYPES, hot)):
                to = bucket_of((keys if kind == _HOT_TYPES else contexts)[part], u.buckets)
                yield _blobs(_deal(to, kind, 0, contexts[part], keys[part], counts[part], word_counts[part]))
        yield _blobs([(0, _COUNTS, 0, n.tobytes(), None, None, None)])

    return run


def _types(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """contexts, keys, counts, word counts."""
    return tuple(_array([x[i] for x in rows], t) for i, t in ((3, np.uint64), (4, np.uint64), (5, np.int64), (6, np.int64)))


def _hot_sums(u: Unigrams, d: Discount):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(u.hot), 2))
        for row in _rows(batches):
            contexts, _, counts, word_counts = _types([row])
            at = find(u.hot, contexts)[0]
            np.add.at(total, at, np.stack([counts - d.kept(counts), u.p(word_counts)], axis=1))
        found = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found, 0]), pa.array(total[found, 1])], ["at", "lost", "p"])

    return run


def alpha(tokens: np.ndarray, lost: np.ndarray, seen: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Each context's denominator, and the factor of the unigram probabilities of words that it was not seen with."""
    total = tokens + (lost <= 0)
    return total, (lost + (lost <= 0)) / total / np.maximum(1 - seen, unknown)


def _deltas(u: Unigrams, d: Discount, counts: np.ndarray, word_counts: np.ndarray, total: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.log10(d.kept(counts) / total) - np.log10(u.p(word_counts)) - np.log10(a)


def _pair_tables(u: Unigrams, d: Discount):
    """Deltas of the pairs and alphas of the contexts that are not hot, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            own = list(rows)
            words = _read_words([x for x in own if x[1] == _WORDS])
            contexts, keys, counts, word_counts = _types([x for x in own if x[1] == _TYPES])
            if not len(contexts):
                continue
            order = np.argsort(contexts, kind="stable")
            contexts, keys, counts, word_counts = contexts[order], keys[order], counts[order], word_counts[order]
            first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
            sizes = np.diff(np.append(first, len(contexts)))
            total, a = alpha(_counts_of(u, *words, contexts[first]), np.add.reduceat(counts - d.kept(counts), first), np.add.reduceat(u.p(word_counts), first), u.unknown)
            yield _blobs(_deal(bucket_of(contexts[first], u.buckets), _CONTEXTS, 0, contexts[first], np.log10(a)))
            yield _blobs(_deal(bucket_of(keys, u.buckets), _PAIRS, 0, keys, _deltas(u, d, counts, word_counts, np.repeat(total, sizes), np.repeat(a, sizes))))

    return run


def _hot_tables(u: Unigrams, d: Discount, total: np.ndarray, a: np.ndarray):
    """Deltas of the pairs after hot contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            contexts, keys, counts, word_counts = _types([row])
            at = find(u.hot, contexts)[0]
            yield _blobs(_deal(bucket_of(keys, u.buckets), _PAIRS, 0, keys, _deltas(u, d, counts, word_counts, total[at], a[at])))

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame) -> Model:
    """Learns from (doc_id, text) and writes the tables: words, and for each round the pairs' deltas and contexts' alphas."""
    spark = docs.sparkSession
    docs = _texts(docs)
    with _small_batches(spark):
        counted = docs.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        words = write_shared(counted, "katz-words", "zstd")
        table = spark.read.parquet(words)
        coc = [F.count(F.when(F.col("n") == r, 1)) for r in range(1, DISCOUNTED + 2)]
        tokens, types, *n = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *coc).first()
        discount = Discount.of([0, *n])
        lost = sum((1 - discount.factors[r]) * r * n[r - 1] for r in range(1, DISCOUNTED + 1))
        more = int(lost <= 0)
        # A word has 1 / HOT_SHARE of all tokens at most HOT_SHARE times.
        often = {r["word"]: r["n"] for r in table.where((F.col("n") * HOT_SHARE >= tokens) | (F.col("word") == int(END.view(np.int64)))).collect()}
        n_docs = often.get(int(END.view(np.int64)), 0)
        hot = np.array([*often, int(BEGIN.view(np.int64))], np.int64).view(np.uint64)
        order = np.argsort(hot)
        buckets = max(LEAST_BUCKETS, tokens // BUCKET_TOKENS)
        u = Unigrams(tokens, types, discount, more, (lost + more) / max(1, tokens + more), hot[order], np.array([*often.values(), 0], np.int64)[order], buckets)

        stored = spark.read.parquet(write_shared(table.mapInArrow(_words_dealt(u), BLOB), "katz-words-dealt", "zstd"))
        staged = []
        for r in range(ROUNDS):
            dealt = _dealt(stored.unionByName(docs.mapInArrow(_pairs_dealt(u, r), BLOB)))
            staged.append(write_shared(dealt.mapInArrow(_pair_types(u), BLOB), f"katz-types-{r}", "zstd", by=("kind",)))
        n = np.zeros(DISCOUNTED + 2, np.int64)
        for path in staged:
            for row in _read(spark, path).where(F.col("kind") == _COUNTS).select("a").collect():  # a row for each task
                n += np.frombuffer(row["a"], np.int64)
        d = Discount.of(n.tolist())

        rounds, alphas = [], np.zeros(len(u.hot))
        as_context = u.hot_counts + np.where(u.hot == BEGIN, n_docs, 0)
        for path in staged:
            own = _read(spark, path)
            often = own.where(F.col("kind") == _HOT_TYPES)
            lost, seen, there = np.zeros(len(u.hot)), np.zeros(len(u.hot)), np.zeros(len(u.hot), bool)
            for row in often.mapInArrow(_hot_sums(u, d), "at bigint, lost double, p double").groupBy("at").agg(F.sum("lost").alias("lost"), F.sum("p").alias("p")).collect():  # at most a row for each hot word
                lost[row["at"]], seen[row["at"]], there[row["at"]] = row["lost"], row["p"], True
            total, a = alpha(np.maximum(as_context, 1), lost, seen, u.unknown)
            alphas[there] = np.log10(a[there])
            cold = _dealt(stored.unionByName(own.where(F.col("kind") == _TYPES))).mapInArrow(_pair_tables(u, d), BLOB)
            rounds.append(write_shared(cold.unionByName(often.mapInArrow(_hot_tables(u, d, total, a), BLOB)), "katz-pairs", "zstd", by=("kind",)))
            discard(spark, path)
    return Model(u, words, rounds, alphas)


def _asked_words(model: Model):
    """A row for each slice with its documents and what hot words give them, and its other words by bucket."""
    u = model.unigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, own = u.base(u.hot_counts), np.log10(u.p(u.hot_counts))
        for batch in batches:
            sums, n_tokens = None, None
            for s in token_slices(batch, numbered=True):
                if sums is None:
                    sums, n_tokens = np.zeros((3, s.end - s.begin)), np.zeros(s.end - s.begin, np.int64)
                n_docs = len(n_tokens)
                n_tokens += np.bincount(s.owner, minlength=n_docs)
                at, hot = find(u.hot, s.tokens)
                at, owner = at[hot], s.owner[hot]
                context_at, hot_context = find(u.hot, s.contexts)
                # A word gives its alpha where it stands as a context, at the token after it: hot ones here, others with their bucket.
                sums += np.stack([np.bincount(owner, x, n_docs) for x in ((u.hot_counts[at] > 0).astype(float), base[at], own[at])])
                sums[2] += np.bincount(s.owner[hot_context], model.hot_alphas[context_at[hot_context]], n_docs)
                parts = []
                for contexts, rows, keys in ((0, s.owner[~hot], s.tokens[~hot]), (1, s.owner[~hot_context], s.contexts[~hot_context])):
                    parts.append((keys, rows, np.full(len(keys), contexts, np.uint8)))
                keys, rows, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                keys, rows, counts = _distinct(keys, rows.astype(np.uint32) * 2 + role)
                out = _deal(bucket_of(keys, u.buckets), _ASKED, s.number, keys, rows, counts)
                if s.last:
                    ids = batch.column("doc_id").slice(s.begin, n_docs)
                    nulls = ids.is_null().to_numpy(zero_copy_only=False)
                    meta = np.stack([ids.fill_null(0).to_numpy(), nulls.astype(np.int64), n_tokens])
                    out.append((s.number % u.buckets, _HEAD, s.number, meta.tobytes(), sums.tobytes(), None, None))
                    sums = None
                yield _blobs(out)

    return run


def _distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row) in order, and how often each occurs."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return keys[at], rows[at], np.diff(np.append(at, len(keys))).astype(np.uint32)


def _asked_pairs(u: Unigrams, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in token_slices(batch, numbered=True):
                own = s.contexts % np.uint64(ROUNDS) == r
                keys, rows, counts = _distinct(pair(s.contexts[own], s.tokens[own]), s.owner[own].astype(np.uint32))
                yield _blobs(_deal(bucket_of(keys, u.buckets), _ASKED, s.number, keys, rows, counts))

    return run


def _answered(words: bool, u: Unigrams):
    """For each slice and bucket one row with the sums of its documents: pairs asked for, known words, base score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            tables: dict[int, list[tuple]] = {}
            ready = None
            for row in rows:
                if row[1] == _HEAD:
                    yield _blobs([row])
                    continue
                if row[1] != _ASKED:
                    tables.setdefault(row[1], []).append(row)
                    continue
                if ready is None:
                    ready = {k: _table(v, np.int64 if k == _WORDS else np.float64) for k, v in tables.items()}
                yield _blobs([_answer(row, ready, words, u)])

    return run


def _table(rows: list[tuple], kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys, values = _array([x[3] for x in rows], np.uint64), _array([x[4] for x in rows], kind)
    order = np.argsort(keys)
    return keys[order], values[order]


_NONE = (np.zeros(0, np.uint64), np.zeros(0))


def _answer(row: tuple, tables: dict[int, tuple[np.ndarray, np.ndarray]], words: bool, u: Unigrams) -> tuple:
    keys, rows, counts = np.frombuffer(row[3], np.uint64), np.frombuffer(row[4], np.uint32), np.frombuffer(row[5], np.uint32)
    sums = np.zeros((4, (int(rows.max()) >> int(words)) + 1))
    n_docs = sums.shape[1]

    def add(line: int, docs: np.ndarray, values: np.ndarray) -> None:
        sums[line] += np.bincount(docs, values, n_docs)

    if words:
        as_token, docs = rows & 1 == 0, rows >> 1
        found = np.zeros(len(keys), np.int64)
        at, there = find(tables.get(_WORDS, _NONE)[0], keys)
        if there.any():
            found[there] = tables[_WORDS][1][at[there]]
        n, d, c = counts[as_token], docs[as_token], found[as_token]
        for line, x in ((1, n * (c > 0)), (2, n * u.base(c)), (3, n * np.log10(u.p(c)))):
            add(line, d, x.astype(float))
        at, there = find(tables.get(_CONTEXTS, _NONE)[0], keys)
        there &= ~as_token
        if there.any():
            add(3, docs[there], counts[there] * tables[_CONTEXTS][1][at[there]])
    else:
        add(0, rows, counts.astype(float))
        at, there = find(tables.get(_PAIRS, _NONE)[0], keys)
        if there.any():
            add(3, rows[there], counts[there] * tables[_PAIRS][1][at[there]])
    return (0, _SUMS, row[2], sums.tobytes(), None, None, None)


def _gathered():
    """Rows of one slice, its head first, as a row for each document."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[2]):
            heads, meta, total = 0, None, None
            for row in rows:
                if row[1] == _HEAD:
                    heads += 1
                    meta = np.frombuffer(row[3], np.int64).reshape(3, -1)
                    head = np.frombuffer(row[4], np.float64).reshape(3, -1)
                    total = np.zeros((4, meta.shape[1])) if total is None else total
                    total[1:] += head
                    continue
                if total is None:
                    raise ValueError("a slice of texts was read differently by two tasks")
                sums = np.frombuffer(row[3], np.float64).reshape(4, -1)
                total[:, : sums.shape[1]] += sums
            # Equal slices send equal rows: each has its share. All pairs must have been asked for.
            total /= heads
            if not np.array_equal(np.rint(total[0]).astype(np.int64), meta[2]):
                raise ValueError("a slice of texts was read differently by two tasks")
            ids = pa.array(meta[0], pa.int64(), mask=meta[1] != 0)
            for _ in range(heads):
                yield pa.RecordBatch.from_arrays([ids, pa.array(meta[2]), pa.array(np.rint(total[1]).astype(np.int64)), pa.array(total[2]), pa.array(total[3])], names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of (doc_id, text); base_score: by add-one unigrams."""
    spark, u = docs.sparkSession, model.unigrams
    docs = _texts(docs)
    with _small_batches(spark), workspace(spark):
        tables = [_read(spark, path) for path in model.rounds]
        words = spark.read.parquet(model.words).mapInArrow(_words_dealt(u), BLOB)
        for t in tables:
            words = words.unionByName(t.where(F.col("kind") == _CONTEXTS))
        asked = _dealt(words.unionByName(docs.mapInArrow(_asked_words(model), BLOB)))
        answers = [write_shared(asked.mapInArrow(_answered(True, u), BLOB), "katz-answers", "zstd")]
        for r, t in enumerate(tables):
            asked = _dealt(t.where(F.col("kind") == _PAIRS).unionByName(docs.mapInArrow(_asked_pairs(u, r), BLOB)))
            answers.append(write_shared(asked.mapInArrow(_answered(False, u), BLOB), "katz-answers", "zstd"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        together = _read(spark, *answers).repartition(n, "id").sortWithinPartitions("id", "kind")
        out = write_shared(together.mapInArrow(_gathered(), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"), "katz-scores", keep=True)
    return spark.read.parquet(out)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7; rows of fold 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))
