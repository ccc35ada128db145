"""A content-addressed store of token ids.

Ids are cut into chunks where a rolling hash of the last ids says so, so equal passages give equal chunks wherever they
stand. A chunk's address is a digest of its ids. The store has three kinds of Parquet files in the shared folder:

- chunks: digest, n, ids (numbers of 2 bytes, or 4 for a large vocabulary); one row for each digest;
- recipes: doc_id, n_tokens, the digests in order and their Merkle root, in ascending order of doc_id (nulls first);
- manifest: for each file range of recipes its documents, tokens, and a digest over their roots.

Reading back recomputes every digest from the stored ids, every root from the digests and the manifest from the roots, and
fails where one differs or a chunk or recipe is missing. A null text is empty and has the end id alone. Texts are whole,
however long. Repeated doc_ids each have a recipe. Columns beside doc_id and text are dropped, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.llm import kernels
from barograph.sources.tables import discard, write_shared

#: Ids in the rolling hash; bits that must be zero for a cut (an average of 2**BITS ids); bounds of a chunk.
SPAN, BITS, LEAST, MOST = 8, 10, 256, 8192
#: Digests that a task remembers, so that it stages a chunk's ids once.
REMEMBERED = 200_000


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves; an odd one goes up as it is."""
    while len(leaves) > 1:
        pairs = [digest(leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0] if leaves else digest(b"")


@cache
def _gear() -> np.ndarray:
    return kernels.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Where the chunks of each document end; document i's ids end at ends[i]."""
    codes = _gear()[ids & np.asarray(0xFFFF, ids.dtype)]
    rolling = codes.copy()
    for j in range(1, SPAN):
        rolling[j:] += codes[:-j] << np.uint32(j)
    marks = np.flatnonzero(rolling >> np.uint32(32 - BITS) == 0) + 1
    at = np.searchsorted(marks, ends).tolist()
    marks, out, begin, m = marks.tolist(), [], 0, 0
    for end, stop in zip(ends.tolist(), at, strict=True):
        own, last = [], begin
        for mark in marks[m:stop]:
            while mark - last > MOST:
                last += MOST
                own.append(last)
            if mark - last >= LEAST:
                last = mark
                own.append(last)
        while end - last > MOST:
            last += MOST
            own.append(last)
        if end > last:
            own.append(end)
        out.append(own)
        begin, m = end, stop
    return out


def _staged(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from barograph.llm.tokens import worker_encoder

        encoder, seen = worker_encoder(tokenizer, end_id), set()
        width = encoder.dtype.itemsize
        for batch in batches:
            for part in kernels.slices(batch, "text", 1 << 21):
                data, ends = encoder.encode_column(part.column("text").fill_null(""))
                docs = []
                begin = 0
                for own, end in zip(cuts(np.frombuffer(data, encoder.dtype), ends), ends.tolist(), strict=True):
                    names, sizes, payloads = [], [], []
                    a = begin
                    for b in own:
                        ids = data[a * width : b * width]
                        name = digest(ids)
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        payloads.append(None if name in seen else ids)
                        seen.add(name)
                        names.append(name)
                        sizes.append(b - a)
                        a = b
                    docs.append((end - begin, merkle(names), names, sizes, payloads))
                    begin = end
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*docs, strict=True), kinds, strict=True)]], ["doc_id", "n_tokens", "root", "digests", "sizes", "payloads"])

    return run


class Store(NamedTuple):
    """Paths of the store's tables; ``width``: bytes of a stored id."""

    chunks: str
    recipes: str
    manifest: str
    width: int


def write(docs: DataFrame, tokenizer: str, end_id: int = 0) -> Store:
    """Encodes (doc_id, text) and writes the store. ``tokenizer``: a file of the tokenizers library that all executors have."""
    from barograph.llm.tokens import Encoder

    spark = docs.sparkSession
    schema = "doc_id bigint, n_tokens bigint, root binary, digests array<binary>, sizes array<int>, payloads array<binary>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_staged(tokenizer, end_id), schema)
    path = write_shared(rows.withColumn("row", F.monotonically_increasing_id()), "store-staged", "zstd")
    staged = spark.read.parquet(path)

    # The first row that staged a chunk stores it. Only digests move to find it.
    named = staged.select("row", F.explode(F.arrays_zip("digests", F.transform("payloads", lambda p: p.isNotNull()).alias("has"), F.transform("sizes", lambda _, i: i).alias("seq"))).alias("c")).where("c.has")
    keepers = named.groupBy("c.digests").agg(F.min(F.struct("row", "c.seq")).alias("first")).groupBy("first.row").agg(F.collect_list("first.seq").alias("kept"))
    chunks = staged.select("row", "digests", "sizes", "payloads").join(keepers, "row").select(F.explode("kept").alias("i"), "digests", "sizes", "payloads")
    chunks = chunks.select(F.col("digests")[F.col("i")].alias("digest"), F.col("sizes")[F.col("i")].alias("n"), F.col("payloads")[F.col("i")].alias("ids"))
    chunks = write_shared(chunks, "store-chunks", "zstd")

    ranged = staged.select("doc_id", "row", "n_tokens", "root", "digests").repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    recipes = write_shared(ranged.withColumn("part", F.spark_partition_id()), "store-recipes")
    discard(spark, path)
    manifest = _manifest(spark.read.parquet(recipes))
    return Store(chunks, recipes, write_shared(manifest, "store-manifest"), Encoder(tokenizer, end_id).dtype.itemsize)


def _range_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file range of the sorted recipes: the Merkle root over what they say, from a stack of whole subtrees."""
    part, n_docs, n_tokens, stack = None, 0, 0, []

    def done() -> pa.RecordBatch:
        root = stack[-1][1] if stack else digest(b"")
        for _, left in reversed(stack[:-1]):
            root = digest(left + root)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([root], pa.binary())], ["part", "n_docs", "n_tokens", "root"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "row", "n_tokens", "root")], strict=True):
            if row[0] != part:
                if part is not None:
                    yield done()
                part, n_docs, n_tokens, stack = row[0], 0, 0, []
            n_docs, n_tokens = n_docs + 1, n_tokens + row[3]
            height, node = 0, digest(repr(row[1:4]).encode() + row[4])
            while stack and stack[-1][0] == height:
                height, node = height + 1, digest(stack.pop()[1] + node)
            stack.append((height, node))
    if part is not None:
        yield done()


def _manifest(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root of each file range."""
    rows = recipes.select("part", "doc_id", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "row")
    return rows.mapInArrow(_range_roots, "part int, n_docs bigint, n_tokens bigint, root binary")


def _read_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, crcs = batch.column("digest").to_pylist(), []
            for name, n, ids in zip(names, batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest(ids) != name or len(ids) != n * width:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return run


_CRC = 0xEDB88320  # fixed: the reversed polynomial of CRC-32


def _times(a: int, b: int) -> int:
    """a * b modulo the polynomial; bit 31 is the power 0."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return product


@lru_cache(maxsize=1 << 14)
def _shift(n_bytes: int) -> int:
    """x ** (8 * n_bytes)."""
    power, square = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            power = _times(square, power)
        square = _times(square, square)
        n_bytes >>= 1
    return power


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two byte strings one after the other."""
    return _times(_shift(second_bytes), first) ^ second


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for root, chunks, n_tokens in zip(batch.column("root").to_pylist(), batch.column("chunks").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            chunks.sort(key=lambda c: c["seq"])
            if merkle([c["digest"] for c in chunks]) != root or sum(c["n"] for c in chunks) != n_tokens:
                raise ValueError("a recipe does not give its root")
            crc = chunks[0]["crc"] if chunks else 0
            for c in chunks[1:]:
                crc = crc32_joined(crc, c["crc"], 4 * c["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(crcs, pa.int64())], ["row", "ids_crc32"])


def _or_fail(column: str, kind: str, message: str) -> Column:
    """The column, or an error where it is null."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(message)).cast(kind)).alias(column)


def read_back(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; the ids themselves never leave the task that reads them."""
    chunks = spark.read.parquet(store.chunks).mapInArrow(_read_chunks(store.width), "digest binary, n int, crc bigint")
    recipes = spark.read.parquet(store.recipes)
    parts = recipes.select("row", "n_tokens", "root", F.posexplode("digests").alias("seq", "digest")).join(chunks, "digest", "left")
    parts = parts.select("row", "n_tokens", "root", "seq", "digest", "n", _or_fail("crc", "bigint", "a chunk is missing"))
    whole = parts.groupBy("row").agg(F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("seq", "digest", "n", "crc")).alias("chunks"))
    crcs = whole.mapInArrow(_fold, "row bigint, ids_crc32 bigint")

    manifest = spark.read.parquet(store.manifest)
    found = _manifest(recipes).select(F.col("part").alias("found"), F.col("root").alias("found_root"))
    same = F.when((F.col("part") == F.col("found")) & (F.col("root") == F.col("found_root")), F.col("part")).alias("part")
    checked = manifest.join(found, F.col("part") == F.col("found"), "full").select(same, "n_tokens").select(_or_fail("part", "int", "the recipes do not give the manifest"), "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file range
    offsets = checked.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("part", "row", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("own")).join(offsets, "part")
    out = starts.join(crcs, "row", "left")
    return out.select("doc_id", (F.col("own") + F.col("offset")).alias("start"), "n_tokens", _or_fail("ids_crc32", "bigint", "a recipe has no chunks"))


def _joined(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids = b"".join(c["ids"] for c in sorted(row.column("chunks").to_pylist()[0], key=lambda c: c["seq"]))
                values = pa.array(np.frombuffer(ids, f"<u{width}").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([row.column("row"), row.column("doc_id"), lists], ["row", "doc_id", "ids"])

    return run


def documents_of(spark: SparkSession, store: Store) -> DataFrame:
    """row, doc_id, ids (array of int): the documents put together again."""
    chunks = spark.read.parquet(store.chunks).select("digest", "ids")
    parts = spark.read.parquet(store.recipes).select("row", "doc_id", F.posexplode("digests").alias("seq", "digest")).join(chunks, "digest", "left")
    parts = parts.select("row", "doc_id", "seq", _or_fail("ids", "binary", "a chunk is missing"))
    whole = parts.groupBy("row", "doc_id").agg(F.collect_list(F.struct("seq", "ids")).alias("chunks"))
    return whole.mapInArrow(_joined(store.width), "row bigint, doc_id bigint, ids array<int>")
