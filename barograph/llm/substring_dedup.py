"""Substring deduplication by sliding spans of sentences.

From each sentence a span goes on until it has SENTENCES sentences and WORDS words, and another goes back from it
likewise; spans that run out of text are dropped. Equal spans meet by two 64-bit hashes over all documents; every one
but the first (least doc_id, then least hash of the text, then place) is repeated, and the sentences that repeated
spans cover are removed. Because spans begin and end at every sentence, a repeated passage that holds a span is covered
whole.

A sentence of more than LONG words counts as several, cut after each word whose hash is the least of some WINDOW words
in a row. Where it is cut depends on the words around alone, so any 50 words that stand again inside one sentence, between
other neighbours, hold spans; the words before the first common cut and after the last stay. Of sentences of LONG words or
less, any 50 words that stand again hold at least two and WORDS words in whole sentences, so they hold a span too.

Hashes are counted first; only spans whose hash may be a repeated one (a bitmap of fixed size tells) are joined. More
repeated hashes than the bitmap tells apart only let more spans through.

A null text stays null. A text of which nothing is left is empty. Texts are whole, however long. Rows that agree in doc_id
and text are one text and stay alike; of equal texts with different ids the least id's stays. A null doc_id comes after
all others. Columns other than text are kept as they are, whatever they are called. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import bitmaps, kernels
from barograph.sources.tables import materialize

SENTENCES, WORDS = 2, 20
#: Words of a sentence from which on it is cut, and within which there is a cut then.
LONG, WINDOW = 16, 12
#: Bits of the bitmap of repeated hashes: 8 MB.
BITS = 26
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1


def pieces(texts: kernels.Bytes) -> kernels.Sentences:
    """The sentences, long ones cut in pieces."""
    s = kernels.sentences(texts)
    long = s.n_words > LONG
    if not long.any():
        return s
    starts, ends = kernels.spaced_words(texts)
    owner = np.searchsorted(s.starts, starts, side="right") - 1
    inside = long[owner]
    starts, ends, owner = starts[inside], ends[inside], owner[inside]
    hashes = kernels.range_hashes(texts.data, starts, ends)
    n = len(hashes) - WINDOW + 1  # a long sentence has more words than a window
    least = hashes[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, hashes[j : j + n], out=least)
    whole = owner[:n] == owner[WINDOW - 1 :]
    cut = np.zeros(len(hashes), bool)
    for j in range(WINDOW):
        cut[j : j + n] |= whole & (hashes[j : j + n] == least)
    cut = np.flatnonzero(cut[:-1] & (owner[1:] == owner[:-1]))
    begins = np.sort(np.concatenate([s.starts, starts[cut + 1]]))
    of = np.searchsorted(s.starts, begins, side="right") - 1
    stops = s.ends[of]
    stops[np.searchsorted(begins, starts[cut + 1]) - 1] = ends[cut]
    # Words of a sentence that is not cut are as many as before; a piece's are counted.
    n_words = s.n_words[of]
    counted = np.searchsorted(starts, stops) - np.searchsorted(starts, begins)
    n_words = np.where(long[of], np.maximum(counted, 1), n_words)
    return kernels.Sentences(begins, stops, n_words, np.searchsorted(begins, texts.offsets))


def spans(texts: kernels.Bytes) -> tuple[kernels.Sentences, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences or pieces, and of the spans the first of them, the last + 1 and two hashes."""
    s = pieces(texts)
    n = len(s.starts)
    sums = np.concatenate([[0], np.cumsum(s.n_words)])
    at = np.arange(n)
    counts = np.diff(s.first)
    last, begin = np.repeat(s.first[1:], counts), np.repeat(s.first[:-1], counts)
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + WORDS), at + SENTENCES)
    begins = np.minimum(np.searchsorted(sums, sums[1:] - WORDS, side="right") - 1, at + 1 - SENTENCES)
    on = ends <= last
    back = begins >= begin
    back[back] = ends[begins[back]] != at[back] + 1  # else it is also one that goes on
    a, b = np.concatenate([at[on], begins[back]]), np.concatenate([ends[on], at[back] + 1])
    codes = kernels.range_hashes(texts.data, s.starts, s.ends)
    return s, a, b, kernels.run_hashes(codes, a, b), kernels.run_hashes(kernels.mix(codes ^ _OTHER), a, b)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernels.release()
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(spans(kernels.text_bytes(part.column("text")))[3].view(np.int64))], ["h"])


def _placed(bitmap: bytes):
    """Rows of the spans whose bit is set, with the characters that their sentences take up to the next sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                texts = kernels.text_bytes(part.column("text"))
                s, a, b, h, g = spans(texts)
                here = bitmaps.test(bits, h & np.uint64((1 << BITS) - 1))
                a, b, h, g = a[here], b[here], h[here], g[here]
                text = np.searchsorted(s.first, a, side="right") - 1
                stop = np.where(b < s.first[text + 1], np.append(s.starts, len(texts.data))[b], texts.offsets[text + 1])
                start_char, end_char = kernels.char_offsets(texts, s.starts[a], text), kernels.char_offsets(texts, stop, text)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("th").take(rows), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(start_char, pa.int64()), pa.array(end_char, pa.int64())], ["id", "th", "h", "g", "start", "end"])

    return run


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, th, ranges): for each text with repeated spans their character ranges; ``th`` is xxhash64 of the text."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_hashes, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bitmap = bitmaps.build(counted, F.expr(f"h & {(1 << BITS) - 1}"), 1 << BITS)
    placed = materialize(texts.mapInArrow(_placed(bitmap), "id bigint, th bigint, h bigint, g bigint, start bigint, end bigint"), "spans")
    firsts = placed.groupBy("h", "g").agg(F.min(F.struct("id", "th", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "firsts")  # so both sides of the join are plain shuffles, and a hot span's can be split
    again = placed.join(firsts, ["h", "g"]).where(F.struct("id", "th", "start", "end") != F.col("first"))
    return again.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def _without(text: Column, ranges: Column) -> Column:
    """The text outside the sorted ranges."""

    def step(done: Column, r: Column) -> Column:
        kept = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(r["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(done["at"], r["end"]).alias("at"), F.concat(done["kept"], kept).alias("kept"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
    return F.aggregate(ranges, begin, step, lambda done: F.concat(done["kept"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


def deduplicate(docs: DataFrame, removed: str = "_removed") -> DataFrame:
    """docs with the repeated sentences taken out of ``text``, and ``removed``: their sorted character ranges or null.

    A column of docs that is called like ``removed`` is replaced; all others stay.
    """
    names = [c for c in docs.columns if c != removed]
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("own_id"), F.xxhash64(docs["text"]).alias("own_th"), F.struct(*[docs[c] for c in names]).alias("own"))
    rows = rows.join(repeated_ranges(docs), (F.col("own_id") == F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    before = F.col("own")["text"]
    text = F.when(F.col("ranges").isNull() | before.isNull(), before).otherwise(_without(before.cast("string"), F.col("ranges")))
    return rows.select(*[(text if c == "text" else F.col("own")[c]).alias(c) for c in names], F.col("ranges").alias(removed))
