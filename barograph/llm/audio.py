"""Audio columns: polyphase resampling, log-mel filterbanks and energy segments of 8-bit mono WAV files.

Frames are cut in blocks of a fixed shape (BLOCK frames x MELS bands), padded with the floor, and each document's
blocks are kept as one Arrow stream whose column ``mel`` is a fixed-shape tensor beside the time span of each block.
Segments open where a frame's energy passes a high mark and close where it falls under a low one. A document is worked
through in blocks, so memory holds its samples and one block. The same bytes give the same features.

A null or empty media value has no samples, no blocks and no segments. A null text is empty. Texts are never cut, however
long. Repeated rows are repeated; columns beside doc_id and text (or n_bytes and media) are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 8
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS = 256, 128, 20
#: Frames of a block; BLOCK * HOP is a multiple of UP, so that each block begins at the filter's first phase.
BLOCK = 48
#: Samples taken before and after a block for the filter's reach; a multiple of DOWN.
LEAD = 64
#: dB from the loudest frame at which a segment opens and closes.
HIGH, LOW = -6.0, -9.0
UNIT = 192
_HEADER = 44


def wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM at RATE; the bytes are the samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file as ``wav`` writes it."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not an 8-bit PCM WAV file")
    return media[_HEADER : _HEADER + struct.unpack_from("<I", media, 40)[0]]


@cache
def _phases() -> np.ndarray:
    """The resampling filter, one row a phase: a windowed sinc at the narrower band's edge."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(UP * TAPS)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Outputs begin to end - 1 of x at OUT_RATE; begin is a multiple of UP. Outside x is silence."""
    first, last = begin * DOWN // UP - TAPS + 1, (end - 1) * DOWN // UP + 1
    part = np.zeros(last - first, np.float32)
    lo, hi = max(first, 0), min(last, len(x))
    if hi > lo:
        part[lo - first : hi - first] = x[lo:hi]
    views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(end - begin, np.float32)
    for p in range(UP):
        n = len(range(p, end - begin, UP))
        if n:
            at = p * DOWN // UP
            out[p::UP] = views[at : at + DOWN * (n - 1) + 1 : DOWN] @ _phases()[p * DOWN % UP]
    return out


@cache
def _mel_bank() -> np.ndarray:
    """Triangles evenly spread on the mel scale, (FRAME // 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel blocks (n, BLOCK, MELS) as float32 and each frame's energy in dB."""
    x = np.frombuffer(payload, np.uint8)
    n_out = len(x) * UP // DOWN
    frames = max(1, 1 + -(-(n_out - FRAME) // HOP)) if n_out else 0
    blocks, energy = [], []
    for f in range(0, frames, BLOCK):
        n = min(BLOCK, frames - f)
        at = f * HOP * DOWN // UP
        lead = min(at, LEAD)
        part = x[at - lead : at + ((n - 1) * HOP + FRAME) * DOWN // UP + LEAD]
        begin = lead * UP // DOWN
        scaled = resample((part.astype(np.float32) - 128) / 128, begin, begin + (n - 1) * HOP + FRAME)
        scaled[max(0, n_out - f * HOP) :] = 0  # the filter rings on after the last sample
        cut = np.lib.stride_tricks.sliding_window_view(scaled, FRAME)[::HOP] * _hann()
        spectrum = np.fft.rfft(cut, axis=1)
        power = spectrum.real.astype(np.float32) ** 2 + spectrum.imag.astype(np.float32) ** 2
        block = np.full((BLOCK, MELS), np.log(np.float32(1e-6)), np.float32)
        block[:n] = np.log(power @ _mel_bank() + np.float32(1e-6))
        blocks.append(block)
        energy.append(10 * np.log10(power.sum(axis=1) + 1e-9))
    return (np.stack(blocks), np.concatenate(energy)) if blocks else (np.zeros((0, BLOCK, MELS), np.float32), np.zeros(0))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of frames between an opening and the next closing."""
    if not len(energy):
        return []
    top = energy.max()
    said = np.where(energy >= top + HIGH, 1, np.where(energy < top + LOW, 0, -1))
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    open_ = np.where(last >= 0, said[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], open_, [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _ms(frame: int) -> int:
    return frame * HOP * 1000 // OUT_RATE


def tensors(blocks: np.ndarray) -> bytes:
    """An Arrow stream of (start_ms, end_ms, mel) with mel a fixed-shape tensor."""
    mel = pa.FixedShapeTensorArray.from_numpy_ndarray(blocks) if len(blocks) else pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS)), pa.array([], pa.list_(pa.float32(), BLOCK * MELS)))
    at = range(len(blocks))
    batch = pa.RecordBatch.from_arrays([pa.array([_ms(i * BLOCK) for i in at], pa.int64()), pa.array([_ms((i + 1) * BLOCK) for i in at], pa.int64()), mel], ["start_ms", "end_ms", "mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [b or b"" for b in part.column("body").to_pylist()]
            media = [wav(t + b" " * (-len(t) % UNIT or (0 if t else UNIT))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, as samples."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    return rows.mapInArrow(_media, "doc_id bigint, n_bytes bigint, media binary")


_KEPT = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, mel binary, segments array<struct<start_ms: bigint, end_ms: bigint>>"
_SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for media in part.column("media").to_pylist():
                payload = samples_of(media) if media else b""
                blocks, energy = log_mel(payload)
                spans = [{"start_ms": _ms(a), "end_ms": _ms(b)} for a, b in segments(energy)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), tensors(blocks), spans))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "mel", "segments"]
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *new], ["doc_id", "n_bytes", *names])


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with what was read back from the media, ``mel`` (an Arrow stream of tensors) and ``segments``."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, f"doc_id bigint, n_bytes bigint, {_KEPT}")


def digests(found: DataFrame) -> DataFrame:
    """The features as one string: a digest of the tensors and the segments."""
    feature = F.sha2(F.concat("mel", F.to_binary(F.to_json("segments"), F.lit("utf-8"))), 256)
    return found.withColumn("feature", feature).drop("mel", "segments")
