"""SentencePiece BPE with seeded merge-dropout, and its inverse.

Encoding merges, again and again, the adjacent pair whose piece scores best (the leftmost of equals). Each time a merge
comes up on a chunk's agenda, a hash of (seed, hash of doc_id, place of the chunk in the text, step, piece) skips it with
probability ``dropout``; what was skipped comes up again after the next merge that happens. So every occurrence of a
word draws its own skips; a seed gives one segmentation, other seeds others, all made of the vocabulary's merges.
Characters without a piece become byte pieces, also a literal U+2581, so decoding gives the text back. Without dropout
the ids are SentencePiece's.

No piece goes from other characters on to a space, so a text is a sequence of chunks (spaces and what follows). Many
chunks advance together, one step of each agenda at a time, in arrays. What a worker keeps does not depend on the draws:
a chunk's tree of decisions, whose node says which piece comes up after the merges and skips that led there, and whose
leaf has the ids; chunks of over LONG characters, as texts without spaces give, go through a heap one by one. Each occurrence goes down its chunk's tree by its own draws; one that leaves what is known of the tree
is worked out from its characters, and its path is added.

A null or empty text has no ids and decodes to the empty text. Texts are whole, however long. Repeated rows give the same
ids, as equal doc_ids (null is one) and texts draw the same skips. Ids do not depend on what else a task encodes. Columns
beside doc_id and text are dropped, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm import kernels

DROPOUT, SEED = 0.1, 1
#: Nodes of decision trees that a worker keeps, unless told otherwise, before it begins anew: some 70 bytes each. Longer
#: chunks than KEPT_CHARS have no tree.
CACHE_NODES, KEPT_CHARS = 5_000_000, 32
_GOLD = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1
_SPACE = "▁"
#: Marks of chunks that came before: 8 MB.
SEEN = 1 << 23
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 21
#: Elements of one call's arrays.
_CELLS = 1 << 19
#: Characters from which a chunk has an agenda of its own.
LONG = 1024
_RUNS = re.compile(" +[^ ]*")


def _mix(x: int) -> int:
    """``kernels.mix`` of one number."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _U64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _U64
    return x ^ x >> 31


class Pieces:
    """The vocabulary of a model file, as tables."""

    def __init__(self, path: str, dropout: float, seed: int, kept: int = CACHE_NODES) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(_SPACE in p.lstrip(_SPACE) for p in normal):
            raise ValueError("pieces with a space after other characters are not supported")
        self.dropout, self.seed, self.n, self.kept = dropout, seed, n, kept
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.score = np.array([model.get_score(i) for i in range(n)], np.float32)
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")], self.char[ord(_SPACE)] = self.char[ord(_SPACE)], -1
        pairs = {(normal[p[:k]], normal[p[k:]]): i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.array(list(pairs.values()), np.int32)[order]
        self.text = [p.replace(_SPACE, " ").encode() for p in names]
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = bytes([b])
        self.seen = np.zeros(SEEN, bool)
        self.pairs: dict[int, int] | None = None
        self._forget()

    def _forget(self) -> None:
        """Begins the trees anew. ``roots``: a chunk's node. Of a node: the hash of (step, piece) and what follows a merge and a
        skip: a node, below 0 a leaf (-1 - its place in ``leaves``), or 0 if not known yet."""
        self.roots: dict[str, int] = {}
        self.leaves: list[bytes] = []
        self.n_nodes = 1
        self.salts, self.follows = np.zeros(1 << 16, np.uint64), np.zeros(1 << 17, np.int32)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)

    def _segment(self, codes: np.ndarray, lengths: np.ndarray, keys: np.ndarray, trace: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Symbols, which of them are left, and if ``trace`` the draws of each step: rows, hashes of (step, piece), skipped.

        codes: (chunks, longest + 1) pieces of single characters, below 0: none."""
        n, last = codes.shape[0], codes.shape[1] - 1
        symbols, at = codes.copy(), np.arange(last + 1)
        following = np.where(at[None, :] + 1 < lengths[:, None], at[None, :] + 1, last)
        before = np.tile(at - 1, (n, 1))
        alive = at[None, :] < lengths[:, None]
        made = np.full((n, last + 1), -1, np.int32)
        made[:, :-1] = self._merged(symbols[:, :-1], symbols[:, 1:])
        score = np.where(made >= 0, self.score[made], -np.inf)
        agenda = score.copy()
        rows, step, drawn_at = np.arange(n), 0, []
        while len(rows):
            step += 1
            best = agenda[rows].argmax(axis=1)
            on = agenda[rows, best] > -np.inf
            rows, best = rows[on], best[on]
            piece = made[rows, best]
            if self.dropout > 0:
                salts = kernels.mix(piece.astype(np.uint64) + np.uint64(step * _GOLD & _U64))
                skipped = self._skips(keys[rows], salts)
                if trace:
                    drawn_at.append((rows, salts, skipped))
                agenda[rows[skipped], best[skipped]] = -np.inf
                r, i, piece = rows[~skipped], best[~skipped], piece[~skipped]
            else:
                r, i = rows, best
            j = following[r, i]
            k = following[r, j]
            symbols[r, i], following[r, i], before[r, k], alive[r, j], score[r, j] = piece, k, i, False, -np.inf
            for a, b in ((i, k), (before[r, i], i)):
                ok = (a >= 0) & (b < last)
                new = self._merged(symbols[r, a], np.where(ok, symbols[r, b], -1))
                new = np.where(ok, new, -1)
                q, a, new = r[a >= 0], a[a >= 0], new[a >= 0]
                made[q, a] = new
                score[q, a] = np.where(new >= 0, self.score[new], -np.inf)
            agenda[r] = score[r]
        return symbols, alive, drawn_at

    def _skips(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return (kernels.mix(keys ^ salts) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < self.dropout

    def _segment_long(self, codes: list[int], key: int) -> np.ndarray:
        """The symbols of one chunk by a heap: as ``_segment``, in time that grows with the length times its logarithm."""
        if self.pairs is None:
            self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist(), strict=True))
        pairs, n, scores = self.pairs.get, self.n, self.score.tolist()
        symbols, following, before = codes, [*range(1, len(codes)), -1], [*range(-1, len(codes) - 1)]
        made = [pairs(a * n + b, -1) if a >= 0 and b >= 0 else -1 for a, b in zip(codes, codes[1:], strict=False)] + [-1]
        # An entry counts as long as its place has the stamp that it was made with.
        stamps = [0] * len(codes)
        agenda = [(-scores[piece], i, 0) for i, piece in enumerate(made) if piece >= 0]
        heapify(agenda)
        least, skipped, step = int(self.dropout * (1 << 53)) + (self.dropout * (1 << 53) % 1 > 0), [], 0
        while agenda:
            entry = heappop(agenda)
            i = entry[1]
            if stamps[i] != entry[2]:
                continue
            step += 1
            if least and _mix(key ^ _mix((made[i] + step * _GOLD) & _U64)) >> 11 < least:
                skipped.append(entry)
                continue
            j = following[i]
            k = following[j]
            symbols[i], following[i] = made[i], k
            stamps[j] = -1  # no entry has it
            if k >= 0:
                before[k] = i
            for a, b in ((i, k), (before[i], i)):
                if a < 0:
                    continue
                left, right = symbols[a], symbols[b] if b >= 0 else -1
                made[a] = pairs(left * n + right, -1) if left >= 0 and right >= 0 else -1
                stamps[a] += 1
                if made[a] >= 0:
                    heappush(agenda, (-scores[made[a]], a, stamps[a]))
            for entry in skipped:
                heappush(agenda, entry)
            skipped.clear()
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = following[i]
        return np.array(out, np.int64)

    def _long(self, chunk: str, key: int) -> bytes:
        known = self.char[points := np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        symbols = self._segment_long(np.where(known >= 0, known, -2 - points.astype(np.int64)).tolist(), key)
        return (self._with_bytes(symbols)[0] if (symbols < 0).any() else symbols).astype(self.dtype).tobytes()

    def _work_out(self, chunks: list[str], keys: np.ndarray, keep: bool) -> list[bytes]:
        """The ids of each occurrence of a chunk, from its characters; if ``keep`` their paths are added to the trees."""
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._long(chunks[i], int(keys[i]))
        order = np.argsort(lengths, kind="stable")[: int((lengths <= LONG).sum())]
        begin = 0
        while begin < len(order):
            # As many chunks of similar lengths as the arrays may hold.
            stop = int(np.searchsorted(lengths[order], lengths[order[begin]] * 5 // 4 + 2, side="right"))
            longest = int(lengths[order[stop - 1]]) + 1
            stop = min(stop, begin + max(1, _CELLS // longest))
            group = order[begin:stop]
            own = lengths[group]
            width = int(own.max()) + 1
            points = np.frombuffer("".join([chunks[g] for g in group]).encode("utf-32-le"), np.uint32)
            place = (np.arange(width)[None, :] < own[:, None]).ravel()
            chars = np.zeros(len(group) * width, np.int64)
            chars[place] = points
            known = self.char[chars]
            codes = np.where(place, np.where(known >= 0, known, -2 - chars), -1).reshape(len(group), width).astype(np.int64)
            symbols, alive, draws = self._segment(codes, own, keys[group], keep)
            ends = np.cumsum(alive.sum(axis=1))
            flat = symbols[alive]
            if (flat < 0).any():
                flat, sizes = self._with_bytes(flat)
                ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
            data, size = flat.astype(self.dtype).tobytes(), self.dtype.itemsize
            edges = [0, *(ends * size).tolist()]
            for g, a, b in zip(group.tolist(), edges, edges[1:], strict=False):
                out[g] = data[a:b]
            if keep:
                self._add([chunks[g] for g in group], [out[g] for g in group], draws)
            begin = stop
        return out

    def _with_bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols with byte pieces in place of characters (below 0), and how many each symbol became."""
        at = np.flatnonzero(symbols < 0)
        points, which = np.unique(-2 - symbols[at], return_inverse=True)
        pieces_ = [self.bytes[list(chr(p).encode())] for p in points.tolist()]
        lengths = np.array([len(p) for p in pieces_])
        sizes = np.ones(len(symbols), np.int64)
        sizes[at] = own = lengths[which]
        out = np.repeat(symbols, sizes)
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        begins = (np.cumsum(lengths) - lengths)[which]
        out[np.repeat((np.cumsum(sizes) - sizes)[at], own) + inside] = np.concatenate(pieces_)[np.repeat(begins, own) + inside]
        return out, sizes

    def _new_nodes(self, salts: np.ndarray) -> np.ndarray:
        """A node for each hash of (step, piece)."""
        made = np.arange(self.n_nodes, self.n_nodes + len(salts), dtype=np.int32)
        self.n_nodes += len(salts)
        while self.n_nodes > len(self.salts):
            self.salts, self.follows = np.append(self.salts, np.zeros_like(self.salts)), np.append(self.follows, np.zeros_like(self.follows))
        self.salts[made] = salts
        return made

    def _new_leaves(self, ids: list[bytes]) -> np.ndarray:
        self.leaves += ids
        return -1 - np.arange(len(self.leaves) - len(ids), len(self.leaves), dtype=np.int32)

    def _add(self, chunks: list[str], ids: list[bytes], draws: list) -> None:
        """Adds the paths of the draws to the chunks' trees."""
        first = np.zeros(len(chunks), np.uint64)
        drawing = np.zeros(len(chunks), bool)
        if draws:
            first[draws[0][0]], drawing[draws[0][0]] = draws[0][1], True
        new = {c: i for i, c in enumerate(chunks) if c not in self.roots}
        at = np.fromiter(new.values(), np.int64, len(new))
        made = np.zeros(len(new), np.int32)
        made[drawing[at]] = self._new_nodes(first[at[drawing[at]]])
        made[~drawing[at]] = self._new_leaves([ids[i] for i in at[~drawing[at]]])
        self.roots.update(zip(new, made.tolist(), strict=True))
        node = np.fromiter(map(self.roots.__getitem__, chunks), np.int32, len(chunks))
        for (rows, _, skipped), (after, salts, _) in zip(draws, [*draws[1:], (np.zeros(0, np.int64), np.zeros(0, np.uint64), None)], strict=False):
            edge = 2 * node[rows].astype(np.int64) + skipped
            goes_on = np.isin(rows, after, assume_unique=True)
            unknown = self.follows[edge] == 0
            edges, of = np.unique(edge[unknown & goes_on], return_index=True)
            made = self._new_nodes(salts[np.searchsorted(after, rows[unknown & goes_on][of])])
            self.follows[edges] = made
            edges, of = np.unique(edge[unknown & ~goes_on], return_index=True)
            self.follows[edges] = self._new_leaves([ids[i] for i in rows[unknown & ~goes_on][of]])
            node[rows] = self.follows[edge]

    def _seen_again(self, chunks: list[str]) -> np.ndarray:
        """Which of the chunks are worth a tree: short ones that also came before, or twice now (by a hash, so some others too)."""
        marks = np.fromiter(map(hash, chunks), np.int64, len(chunks)) & (SEEN - 1)
        short = np.fromiter(map(len, chunks), np.int64, len(chunks)) <= KEPT_CHARS
        _, of, counts = np.unique(marks, return_inverse=True, return_counts=True)
        again = short & (self.seen[marks] | (counts > 1)[of])
        self.seen[marks] = True
        return again

    def _walk(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where the draws of each occurrence end: at a leaf, or 0 where the tree is not known."""
        node = node.copy()
        rows = np.flatnonzero(node > 0)
        while len(rows):
            on = node[rows]
            on = self.follows[2 * on.astype(np.int64) + self._skips(keys[rows], self.salts[on])]
            node[rows] = on
            rows = rows[on > 0]
        return node

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype``; ``keys``: a hash for each text, on which its draws depend."""
        chunks = [[] if not t else _RUNS.findall(f" {t}") if "  " in t or t[0] == " " else [f" {u}" for u in t.split(" ")] for t in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        own = kernels.mix(np.array(keys, np.uint64) ^ kernels.mix(np.array([self.seed & _U64], np.uint64) + np.uint64(_GOLD)))
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(begins, sizes)
        draws = kernels.mix(np.repeat(own, sizes) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
        if self.n_nodes + len(self.leaves) > self.kept:
            self._forget()
        ends = self._walk(np.fromiter(map(self.roots.get, flat, repeat(0)), np.int32, len(flat)), draws)
        out = [self.leaves[-1 - e] if e else b"" for e in ends.tolist()]
        missing = np.flatnonzero(ends == 0)
        again = self._seen_again([flat[i] for i in missing])
        for at, keep in ((missing[again], True), (missing[~again], False)):
            for i, ids in zip(at.tolist(), self._work_out([flat[i] for i in at], draws[at], keep), strict=True):
                out[i] = ids
        return [b"".join(out[a : a + n]) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, self.dtype).tolist()))[1:].decode()


@lru_cache(maxsize=1)
def pieces(path: str, dropout: float, seed: int, kept: int) -> Pieces:
    """The worker's own: its tasks share what it knows, until other work begins."""
    kernels.hold("pieces", pieces.cache_clear)
    return Pieces(path, dropout, seed, kept)


def _key(doc_id: int | None) -> int:
    return int.from_bytes(blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


def _encode(path: str, dropout: float, seed: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, dropout, seed, kept)
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE_BYTES):
                texts = part.column("text").fill_null("").to_pylist()
                ids = model.encode(texts, [_key(i) for i in part.column("doc_id").to_pylist()])
                n = [len(i) // model.dtype.itemsize for i in ids]
                back = [model.decode(i) for i in ids]
                crcs = [zlib.crc32(np.frombuffer(i, model.dtype).astype("<u4").tobytes()) for i in ids]
                decoded = [zlib.crc32(t.encode()) for t in back]
                same = [a == b for a, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_crc32", "lossless"])

    return run


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, kept: int = CACHE_NODES) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian numbers of 2 bytes, or 4 for a large vocabulary), their crc32 as numbers of 4
    bytes, the decoded text's crc32, and whether it is the text. ``model``: a SentencePiece BPE file that all executors have.
    ``kept``: nodes that a worker keeps; fewer take less memory and more time, the ids are the same."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model, dropout, seed, kept), "doc_id bigint, n_tokens bigint, ids binary, ids_crc32 bigint, decoded_crc32 bigint, lossless boolean")


def _decode(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, dropout, seed, CACHE_NODES)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id and text from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model, dropout, seed), "doc_id bigint, text string")
