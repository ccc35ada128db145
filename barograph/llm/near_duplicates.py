"""Near duplicates by BagMinHash over multisets of word shingles, exact verification, and connected classes.

An element of weight w draws points from Poisson processes over the blocks (0, 1], (1, 2], (2, 4], (4, 8], ... of the
weight axis, at a rate of the block's width. A point has an arrival time, a register and a place in its block; places
beyond w do not count, so larger weights only add points. A register keeps its earliest time; two texts agree in one
with the probability of their weighted Jaccard similarity. A process stops once its time passes all registers.

Equal texts are one node. Nodes that agree in a band of registers meet in a bucket, and no two members of a bucket that
end in different classes stay uncompared, unless their multisets cannot be similar enough. Instead of all pairs, hubs are
compared with the members of their bucket, exactly, on the multisets:

1. Every member is compared with the one of its bucket that meets most others. This joins most groups.
2. Of the buckets that still hold several classes, shingles that no other of their texts has are counted. They cannot be
   shared, so a text with many of them cannot reach SIMILARITY with any text of its bucket's sizes, and leaves.
3. What two members share is at most what both share with the bucket's first hub and what they may share besides; most
   pairs are ruled out by these numbers alone. In rounds, HUBS, then HUBS * HUBS members and so on (all of a bucket that
   has no more), those with most links first, are compared with the members of other classes that are not ruled out. A
   member that has been a hub leaves; a bucket is done when its members are of one class.

A group of similar texts so costs a few comparisons for each member.

Shingles are SHINGLE words (the kernels' words); a text of fewer words is one shingle, and no text is cut, however long.
A null text counts as empty. Texts without words are duplicates only if equal. Repeated rows are copies, a null doc_id is
a doc_id like others and comes last. Of equal doc_ids the first row read is kept. Columns beside doc_id and text do not matter,
whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm import bitmaps, kernels
from barograph.sources.tables import materialize, workspace

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of registers: at a similarity of 0.8, 6 in 100,000 pairs agree in none; at 0.85, 1 in 10 million.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Hubs of a bucket in the first round, and their factor from round to round.
HUBS = 64
#: Texts that one call of a kernel takes, so that a text's number fits beside a 54-bit shingle.
_TEXTS = 1000
_SHINGLE_BITS = np.uint64(54)
_MASK = np.uint64((1 << 54) - 1)
_GOLD = 0x9E3779B97F4A7C15


def shingles(texts: kernels.Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (text's number and shingle) and how often each occurs; at most _TEXTS texts."""
    w = kernels.words(texts)
    grams = kernels.gram_hashes(w.hashes, SHINGLE)
    owner = w.owner()
    fits = kernels.inside_texts(w.first, len(grams), SHINGLE)
    keys = [(owner[: len(grams)][fits].astype(np.uint64) << _SHINGLE_BITS) | (grams[fits] & _MASK)]
    counts = np.diff(w.first)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            grams = kernels.gram_hashes(w.hashes, n)[w.first[short]]
            keys.append((short.astype(np.uint64) << _SHINGLE_BITS) | (grams & _MASK))
    return np.unique(np.concatenate(keys), return_counts=True)


def signatures(keys: np.ndarray, weights: np.ndarray, n_texts: int) -> np.ndarray:
    """Arrival times (n_texts, REGISTERS); infinite for a text without elements."""
    times = np.full(n_texts * REGISTERS, np.inf)
    texts, elements = (keys >> _SHINGLE_BITS).astype(np.int64), keys & _MASK
    n_blocks = np.ceil(np.log2(weights)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(keys)), n_blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    text, seed = texts[which], kernels.mix(elements[which] + (block.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
    low = np.where(block > 0, np.exp2(block - 1.0), 0.0)
    width = np.where(block > 0, low, 1.0)
    share = (weights[which] - low) / width  # of the block that lies within the weight; 1 or more: all of it
    now = np.zeros(len(which))
    step = 0
    while len(text):
        step += 1
        a = kernels.mix(seed + np.uint64(step * _GOLD & 0xFFFFFFFFFFFFFFFF))
        b = kernels.mix(a)
        now += -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        register = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        counts = (b >> np.uint64(32)).astype(np.float64) * 2.0**-32 < share
        np.minimum.at(times, (text * REGISTERS + register)[counts], now[counts])
        there, place = (np.arange(n_texts), text) if len(text) > n_texts else np.unique(text, return_inverse=True)
        latest = times.reshape(n_texts, REGISTERS)[there].max(axis=1)
        goes_on = now < latest[place]
        text, seed, width, share, now = text[goes_on], seed[goes_on], width[goes_on], share[goes_on], now[goes_on]
    return times.reshape(n_texts, REGISTERS)


def _numbered(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in kernels.slices(batch, column):
        for at in range(0, part.num_rows, _TEXTS):
            yield part.slice(at, _TEXTS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernels.release()
    for batch in batches:
        for part in _numbered(batch, "text"):
            keys, counts = shingles(kernels.text_bytes(part.column("text")))
            times = signatures(keys, counts, part.num_rows)
            bands = kernels.gram_hashes(times.view(np.uint64).ravel(), ROWS)[::ROWS].reshape(-1, BANDS)
            bands = kernels.mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLD)).view(np.int64)
            some = np.isfinite(times[:, 0])
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(bands[some].ravel()))
            sizes = np.bincount((keys >> _SHINGLE_BITS).astype(np.int64), counts, part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(sizes), flat], ["doc_id", "digest", "size", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, as one array, beside their weights."""
    for batch in batches:
        for part in _numbered(batch, "text"):
            keys, counts = shingles(kernels.text_bytes(part.column("text")))
            edges = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1, dtype=np.uint64) << _SHINGLE_BITS), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int64))) for x in (keys & _MASK, counts)]
            yield pa.RecordBatch.from_arrays([part.column("node"), *lists], ["node", "shingles", "weights"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kernels.release()
    for batch in batches:
        for half in _numbered(batch, "text_a"):
            for part in _numbered(half, "text_b"):
                (ka, ca), (kb, cb) = (shingles(kernels.text_bytes(part.column(c))) for c in ("text_a", "text_b"))
                _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                n = part.num_rows
                of = lambda keys, counts: np.bincount((keys >> _SHINGLE_BITS).astype(np.int64), counts, n)
                both = of(ka[ia], np.minimum(ca[ia], cb[ib]))
                either = of(ka, ca) + of(kb, cb) - both
                # both / either >= SIMILARITY in whole numbers
                linked = (either > 0) & (both * 1000 >= either * round(SIMILARITY * 1000))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both.astype(np.int64)), pa.array(linked)], ["a", "b", "both", "linked"])


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node that (a, b) edges connect each to; nodes without an edge are absent."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "node").select("node", "class", F.least("class", "near").alias("low"))
        # Then to the label's own label, so paths halve each time.
        up = labels.select(F.col("node").alias("low"), F.col("class").alias("up"))
        lower = materialize(lower.join(up, "low", "left").select("node", F.col("class").alias("was"), F.least("low", F.coalesce("up", "low")).alias("class")), "labels")
        labels = lower.select("node", "class")
        if lower.where("was <> class").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, class) after further links (a, b): only classes that these connect are worked on."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("class").alias(f"class_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).where("a <> b")
    moved = components(ends)
    old = labels.join(moved.select(F.col("node").alias("class"), F.col("class").alias("to")), "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return materialize(old.unionByName(moved.join(labels, "node", "left_anti")), "labels")


#: Bits of the bitmap of candidates: 512 KB, whatever the input.
_BITS = 22


def _bit() -> Column:
    return F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % (1 << _BITS)


def digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _may_link(most: Column, size_a: Column, size_b: Column) -> Column:
    """Whether texts of these sizes reach SIMILARITY if they share ``most``."""
    return (1 + SIMILARITY) * most >= SIMILARITY * (size_a + size_b) - 1e-6


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with ``class``, ``n`` and ``least``, the bucket's members and smallest size."""
    labelled = members.drop("class", "least", "n").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "least", "n")
    return labelled.join(mixed, "bucket")


def _shareable(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """The members with ``rest``: the weight of their shingles that some other member, or a hub, has."""
    texts = bodies.join(members.select(F.explode(F.array("node", "hub")).alias("node")).distinct(), "node")
    pieces = texts.mapInArrow(_elements, "node bigint, shingles array<bigint>, weights array<bigint>")
    pieces = pieces.select("node", F.explode(F.arrays_zip("shingles", "weights")).alias("e")).select("node", F.col("e.shingles").alias("shingle"), F.col("e.weights").alias("weight"))
    # A text has a row for each of its shingles, so a shingle of one row is of one text.
    own = pieces.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node"), F.first("weight").alias("weight")).where("n = 1")
    own = own.groupBy("node").agg(F.sum("weight").alias("own"))
    return members.join(own, "node", "left").withColumn("rest", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")


def _class_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, class, n_links of each row; ``class`` is the class's least node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    sketched = materialize(texts.select("doc_id", "digest", "text").mapInArrow(_sketch, "doc_id bigint, digest string, size bigint, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = materialize(sketched.groupBy("digest").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")

    in_buckets = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(in_buckets.join(shared, "bucket"), "members")
    candidates = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest"), "candidates")
    bitmap = bitmaps.build(candidates, _bit(), 1 << _BITS)
    wanted = bitmaps.keep(texts.select("digest", "text", _bit().alias("bit")), bitmap, "bit").groupBy("digest").agg(F.first("text").alias("text"))
    bodies = materialize(wanted.join(candidates, "digest").select("node", "text"), "bodies")

    body = lambda c: bodies.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, both, linked) of the pairs (node, hub), each once."""
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        both = pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(_verify, "a bigint, b bigint, both bigint, linked boolean"), "verified")

    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    hubs = members.join(meets, "node").groupBy("bucket").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("hub"))
    members = materialize(members.select("bucket", "node", "size").join(hubs, "bucket").where("node <> hub"), "members")
    verified = compared(members)
    links = verified.where("linked").select("a", "b")
    labels = components(links)

    members = materialize(_mixed(members, labels), "members")
    members = _mixed(_shareable(members, bodies).where(_may_link(F.col("rest"), F.col("size"), F.col("least"))), labels)
    measured = verified.select("a", "b", F.col("both").alias("common"))
    members = members.withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub")}).join(measured, ["a", "b"]).drop("a", "b", "hub")
    members = materialize(members, "members")
    own = ["node", "class", "size", "rest", "common"]
    hubs_each = HUBS
    while not members.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        part = F.when(F.col("n") <= hubs_each, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(hubs_each)), F.lit(hubs_each)))
        best = F.max_by(F.struct(*own), F.struct(F.coalesce("degree", F.lit(0)), -F.col("node"))).alias("h")
        hubs = members.join(degree, "node", "left").groupBy("bucket", part.alias("part")).agg(best)
        hubs = materialize(hubs.select("bucket", F.col("h.node").alias("hub"), *[F.col(f"h.{c}").alias(f"hub_{c}") for c in own[1:]]), "hubs")
        # What both share with the bucket's first hub, and what each has besides that some other text has.
        besides = lambda c: F.col(f"{c}rest") - F.col(f"{c}common")
        most = F.least("rest", "hub_rest", F.least("common", "hub_common") + F.least(besides(""), besides("hub_")))
        once = (F.col("n") > hubs_each) | (F.col("node") < F.col("hub"))  # where all are hubs
        reach = (F.col("class") != F.col("hub_class")) & once & _may_link(most, F.col("size"), F.col("hub_size"))
        found = compared(members.join(hubs, "bucket").where(reach)).where("linked").select("a", "b")
        if not found.isEmpty():
            links = links.union(found)
            labels = joined(labels, found)
        members = members.join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
        members = materialize(_mixed(members, labels), "members")
        hubs_each *= HUBS

    rows = sketched.select("row", "doc_id", "digest").join(nodes.select("digest", "node"), "digest")
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = rows.join(labels.join(degree, "node"), "node", "left")
    return materialize(rows.select("row", "doc_id", "digest", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "class-rows", keep=True)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id (the class's least doc_id), class_size, n_links, keep; one row for each row of docs.

    ``n_links``: verified links of the row's text to other texts. ``keep``: the row's (doc_id, text) is the class's first.
    """
    with workspace(docs.sparkSession):
        rows = _class_rows(docs)
    firsts = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min_by("digest", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row")).alias("first_digest"))
    out = rows.join(firsts, "class")
    keep = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("first_digest"))
    return out.select("doc_id", "digest", "class_id", "class_size", "n_links", keep.alias("keep"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each class: the one of the least doc_id. Repeated rows become one."""
    kept = classes(docs).where("keep").select(F.col("doc_id").alias("id"), "digest").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), digest().alias("own_digest"), F.struct(*[docs[c] for c in docs.columns]).alias("own"))
    rows = rows.join(kept, (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("id")))
    return rows.dropDuplicates(["own_id", "own_digest"]).select("own.*")
