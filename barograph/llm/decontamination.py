"""Benchmark decontamination by winnowing.

Word k-grams are hashed, and of every WINDOW neighbouring grams the smallest hash is kept, so two texts that share
SPAN = K + WINDOW - 1 words share a fingerprint there. Training fingerprints that may be a benchmark's (a fixed-size
bitmap tells) are joined with the benchmark's, each with the words around it, and every hit is extended word by word;
it counts if it reaches SPAN words. Items of fewer words are one gram of their own length, looked for at every place.

Nulls and texts without words have no words and no hits. Texts are whole, however long. Repeated rows each give a row.
Columns beside doc_id and text are dropped by ``contamination`` and kept by ``clean``, whatever they are called. An empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm import bitmaps, kernels
from barograph.sources.tables import materialize

#: Words of a gram, grams of a window, and the shortest shared span that is always found.
K, WINDOW = 6, 8
SPAN = K + WINDOW - 1
#: Bits of the bitmap of benchmark fingerprints; more fingerprints only make it let more rows through.
BITS = 22

_PRINTS = "array<struct<fp: bigint, k: int, whole: boolean, pos: int, left: array<bigint>, right: array<bigint>>>"
_ARROW_PRINTS = pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("whole", pa.bool_()), ("pos", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The best of each w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def winnowed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window of their text; ties are all kept."""
    grams = kernels.gram_hashes(hashes, K)
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(grams, WINDOW, np.minimum)
    least = np.where(kernels.inside_texts(first, len(least), SPAN), least, np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == grams)
    return at, grams[at]


def _prints(words: kernels.Words, at: np.ndarray, fps: np.ndarray, k: int, whole: bool, owner: np.ndarray) -> Iterator[tuple[int, dict]]:
    signed, reach = words.hashes.view(np.int64), 0 if whole else SPAN - k
    for p, fp in zip(at.tolist(), fps.view(np.int64).tolist(), strict=True):
        d = int(owner[p])
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        left = signed[max(lo, p - reach) : p][::-1].tolist()
        yield d, {"fp": fp, "k": k, "whole": whole, "pos": p - lo, "left": left, "right": signed[p + k : min(hi, p + k + reach)].tolist()}


def _fingerprints(short: list[int], bitmap: bytes | None):
    """A task's work on rows (id, digest, text): with a bitmap, training texts; without, benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        seen = np.frombuffer(bitmap, np.uint8) if bitmap is not None else None
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                words = kernels.words(kernels.text_bytes(part.column("text")))
                owner, counts = words.owner(), np.diff(words.first)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                kinds = [(K, False, *winnowed(words.hashes, words.first))]
                for m in short:
                    grams = kernels.gram_hashes(words.hashes, m)
                    fits = kernels.inside_texts(words.first, len(grams), m)
                    if seen is None:
                        fits &= counts[owner[: len(grams)]] == m
                    at = np.flatnonzero(fits)
                    kinds.append((m, True, at, mixed(grams[at])))
                for k, whole, at, fps in kinds:
                    if seen is not None:
                        here = bitmaps.test(seen, fps & np.uint64((1 << BITS) - 1))
                        at, fps = at[here], fps[here]
                    for d, print_ in _prints(words, at, fps, k, whole, owner):
                        found[d].append(print_)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(counts, pa.int64()), pa.array(found, _ARROW_PRINTS)], ["id", "digest", "n_words", "prints"])

    return run


def mixed(grams: np.ndarray) -> np.ndarray:
    """Grams of whole short items are kept apart from those of K words."""
    return kernels.mix(grams ^ np.uint64(0x5851F42D4C957F2D))


def _common(a: str, b: str):
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    off = F.array_position(same, False)
    return F.when(off > 0, off - 1).otherwise(n)


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (row, doc_id, digest, n_words) for each document, and (row, item_id, start, end) for each extended hit, in words."""
    spark = docs.sparkSession
    short = list(range(1, SPAN))
    schema = f"id bigint, digest string, n_words bigint, prints {_PRINTS}"
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.lit("").alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(short, None), schema)
    items = materialize(items.select("id", "n_words", F.explode("prints").alias("p")).select(F.col("id").alias("item_id"), "n_words", "p.fp", "p.k", "p.whole", F.col("p.left").alias("i_left"), F.col("p.right").alias("i_right")), "benchmark-prints")
    short = sorted(r["k"] for r in items.where("whole").select("k").distinct().collect())  # at most SPAN - 1 rows
    bitmap = bitmaps.build(items, F.expr(f"fp & {(1 << BITS) - 1}"), 1 << BITS)
    found = docs.select(F.col("doc_id").cast("long").alias("id"), _digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(short, bitmap), schema)
    found = materialize(found.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "digest", "n_words", "prints"), "training-prints")
    hits = found.select("row", F.explode("prints").alias("p")).select("row", "p.*").join(items.drop("n_words"), ["fp", "k", "whole"])
    hits = hits.withColumns({"l": _common("left", "i_left"), "r": _common("right", "i_right")})
    hits = hits.where(F.col("whole") | (F.col("l") + F.col("r") + K >= SPAN))
    return found.select("row", "doc_id", "digest", "n_words"), hits.select("row", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("k") + F.col("r")).alias("end")).distinct()


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, hits = occurrences(docs, benchmark)
    hits = materialize(hits, "hits")
    # Words in the union of a row's spans: each span adds what lies behind the furthest end before it.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", "end").distinct().withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    counts = spans.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    items = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.join(counts, "row", "left").join(items, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document is contaminated if a twentieth of its words or more are hit.
    """
    return _judged(docs, benchmark).drop("digest")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text is not contaminated; of rows that share a doc_id, or have none, each is judged by its text."""
    bad = _judged(docs, benchmark).where("contaminated").select("digest").distinct()
    return docs.join(bad, _digest(docs["text"]) == bad["digest"], "left_anti")
