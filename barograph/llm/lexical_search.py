"""Ranked lexical search by hashed max-sketches.

The index has a row for each document: its terms (64-bit hashes) with their occurrences, and a sketch: ROWS rows of
coordinatewise maxima that its terms' impacts are folded into, by another hash for each row. Within a document an impact grows
with the occurrences alone, so the sketch keeps the greatest number of occurrences of each coordinate in one byte (255: any
number from there on), and does not depend on statistics that change as documents come. A row's width is a power of two,
SPARE to 2 * SPARE times the distinct terms.

A term's coordinates hold its occurrences or more, a term's that is not there hold nothing or another's; so the impact of the least
of them, times the term's weight, summed over a query, never lies below the exact score. Queries are looked up in blocks, for all documents of a batch at
once. Then each query goes through the documents by descending bound, rescores exactly, and stops at the first bound below
the score that is TOP-th in this task so far. What tasks keep, TOP rows a query, is ranked once more. No document is left out but
by its bound.

Terms are runs of letters, digits and bytes of non-ASCII characters, A-Z as a-z, of whole texts; null has none. Documents and
queries without terms are in no result; repeated rows are each a document, or a query, of their own. Of equal scores the
lower doc_id ranks first, null before all. Other columns are dropped, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm import kernels, pieces
from barograph.sources.tables import materialize

#: Fixed by the contract.
TOP, SCALE, K1, B_PERCENT = 20, 1_000_000_000, 12, 25
#: Terms of queries that are looked up at once; a longer query is a block of its own.
BLOCK_TERMS = 32_768
#: Cells (documents times terms) of one lookup.
CELLS = 1 << 22
#: Bytes of terms that are put together for a lookup of documents.
LEAST_WIDTH, FULL = 64, 255
#: Rows of a sketch, each with SPARE coordinates for a term at least: a term that is not in a text meets others in all rows 1 time in 40 to 400.
ROWS, SPARE = 4, 2
_ODD = kernels.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)

INDEX = "doc_id bigint, n bigint, terms binary, tfs binary, sketch binary"
_INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary()), ("sketch", pa.binary())])


def _counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, and how often each occurs."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    if weights is None:
        return hashes[first], np.diff(np.append(first, len(hashes)))
    return hashes[first], np.add.reduceat(weights[order], first) if len(first) else weights


def width_of(n_terms: int) -> int:
    """Coordinates of each row."""
    return max(LEAST_WIDTH, 1 << (SPARE * n_terms - 1).bit_length()) if n_terms else LEAST_WIDTH


def coordinates(terms: np.ndarray, width: int) -> list[np.ndarray]:
    """Where the terms stand in each of the ROWS rows of a sketch, which follow one another."""
    shift = np.uint64(65 - width.bit_length())
    return [(terms * odd >> shift).astype(np.int64) + r * width for r, odd in enumerate(_ODD)]


def sketch(terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    width = width_of(len(terms))
    out = np.zeros(ROWS * width, np.uint8)
    tfs = np.minimum(tfs, FULL).astype(np.uint8)
    order = np.argsort(tfs, kind="stable")  # of those that meet, the last one written is the greatest
    for at in coordinates(terms[order], width):
        out[at] = tfs[order]
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in pieces.slices(batch, "text"):
            ids, out = batch.column("doc_id").slice(begin, end - begin), []
            have = [kernels.words(t) for t in texts]
            if len(have) > 1:  # one long text
                parts = [_counted(w.hashes) for w in have]
                docs = [_counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            else:
                docs = [_counted(have[0].hashes[a:b]) for a, b in zip(have[0].first[:-1].tolist(), have[0].first[1:].tolist(), strict=True)]
            for terms, tfs in docs:
                out.append((int(tfs.sum()), terms.tobytes(), tfs.astype(np.uint32).tobytes(), sketch(terms, tfs).tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns, list(_INDEX)[1:], strict=True)]], schema=_INDEX)


def index(docs: DataFrame) -> DataFrame:
    """Rows of INDEX from (doc_id, text), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_index, INDEX)
    return materialize(rows, "lexical-index", "zstd")


class Block(NamedTuple):
    """Some queries: their numbers, the first entry of each, and of each entry the term and its repeats times its weight."""

    queries: list[int]
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _of(values: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in values.to_pylist()]


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of the (distinct, ascending) terms is; absent ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for own in _of(batch.column("terms"), np.uint64):
                at = np.searchsorted(terms, own)
                hit = at[at < len(terms)]
                total[hit[terms[hit] == own[: len(hit)]]] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["at", "df"])

    rows = index.select("terms").mapInArrow(run, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df")).collect()
    return {r["at"]: r["df"] for r in rows}


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term contributes, before its weight."""
    return SCALE * tf // np.maximum(1000 * tf + K1 * m, 1)


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - B_PERCENT + np.array([B_PERCENT * x * n_docs // n_terms for x in n.tolist()], np.int64)


def bounds(block: Block, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores: a row for each of the sketches (of one width), a column for each query."""
    seen = np.arange(FULL + 1, dtype=np.int64)
    table = impacts(seen, m[:, None])
    table[:, FULL] = SCALE // 1000  # no number of occurrences gives more
    # The least of a term's coordinates still lies above its own occurrences.
    first, *others = coordinates(block.terms, sketches.shape[1] // ROWS)
    least = sketches[:, first]
    for at in others:
        np.minimum(least, sketches[:, at], out=least)
    looked_up = np.take_along_axis(table, least.astype(np.int64), axis=1)
    looked_up *= block.weights
    return np.add.reduceat(looked_up, block.first[:-1], axis=1)


def exact(block: Block, q: int, terms: np.ndarray, tfs: np.ndarray, m: int) -> int:
    """The score of query q for one document."""
    a, b = block.first[q], block.first[q + 1]
    at = np.minimum(np.searchsorted(terms, block.terms[a:b]), len(terms) - 1)
    hit = terms[at] == block.terms[a:b]
    return int((block.weights[a:b][hit] * impacts(tfs[at[hit]].astype(np.int64), np.int64(m))).sum())


def _search(block: Block, n_docs: int, n_terms: int, top: int):
    step = max(1, CELLS // max(1, len(block.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in block.queries]  # heaps of (score, minus doc_id)
        for batch in batches:
            ids = [-x if x is not None else math.inf for x in batch.column("doc_id").to_pylist()]
            m = _lengths(batch.column("n").to_numpy(), n_docs, n_terms)
            sketches, terms, tfs = batch.column("sketch").to_pylist(), batch.column("terms"), batch.column("tfs")
            widths = np.array([len(s) for s in sketches])
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for chunk in np.array_split(own, math.ceil(len(own) * max(1, width // 4096) / step)):
                    table = np.frombuffer(b"".join([sketches[i] for i in chunk]), np.uint8).reshape(len(chunk), width)
                    upper = bounds(block, table, m[chunk])
                    for q, heap in enumerate(best):
                        least = heap[0][0] if len(heap) == top else 1
                        near = np.flatnonzero(upper[:, q] >= least)
                        for c in near[np.argsort(-upper[near, q], kind="stable")].tolist():
                            if len(heap) == top and upper[c, q] < heap[0][0]:
                                break
                            i = int(chunk[c])
                            score = exact(block, q, np.frombuffer(terms[i].as_buffer(), np.uint64), np.frombuffer(tfs[i].as_buffer(), np.uint32), int(m[i]))
                            if score > 0:
                                (heapq.heappushpop if len(heap) == top else heapq.heappush)(heap, (score, ids[i]))
        rows = [(block.queries[q], None if d == math.inf else -d, s) for q, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["query", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in pieces.slices(batch, "text"):
            have = [kernels.words(t) for t in texts]
            whole = [np.concatenate([w.hashes for w in have])] if len(have) > 1 else np.split(have[0].hashes, have[0].first[1:-1])
            out = [_counted(h) for h in whole]
            blobs = [pa.array([x[0].tobytes() for x in out], pa.binary()), pa.array([x[1].astype(np.int64).tobytes() for x in out], pa.binary()), pa.array([len(x[0]) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("query").slice(begin, end - begin), *blobs], ["query", "terms", "repeats", "n_terms"])


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents (doc_id, text) for each of the queries (item_id, text)."""
    spark = docs.sparkSession
    indexed = index(docs)
    n_docs, n_terms = indexed.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = materialize(queries.select("item_id", F.col("text").cast("string").alias("text")), "lexical-queries").withColumn("query", F.monotonically_increasing_id())
    items = materialize(items, "lexical-items")
    asked = materialize(items.select("query", "text").mapInArrow(_query_terms, "query bigint, terms binary, repeats binary, n_terms bigint").where("n_terms > 0"), "lexical-terms")
    total = asked.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    n_blocks, found = max(1, math.ceil(total / BLOCK_TERMS)), None
    for b in range(n_blocks if n_terms else 0):
        # About BLOCK_TERMS terms, whatever the number of queries; only a single query can be longer.
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).orderBy("query").collect()
        if not rows:
            continue
        own = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        terms, repeats = np.concatenate(own), np.concatenate([np.frombuffer(r["repeats"], np.int64) for r in rows])
        distinct = np.unique(terms)
        df = document_frequencies(indexed, distinct)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(distinct))], np.int64)
        block = Block([r["query"] for r in rows], np.concatenate([[0], np.cumsum([len(t) for t in own])]), terms, repeats * weights[np.searchsorted(distinct, terms)])
        part = indexed.where("n > 0").mapInArrow(_search(block, n_docs, n_terms, top), "query bigint, doc_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
