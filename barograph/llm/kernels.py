"""Array kernels over the UTF-8 bytes of Arrow string columns, used inside tasks.

A word is a longest run of ASCII letters, digits and bytes of non-ASCII characters; A-Z count as a-z. Because every byte
of a non-ASCII character is 0x80 or more, words can be found on bytes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel takes, unless one text alone is longer. Its arrays are some 40 times as large.
SLICE_BYTES = 1 << 19

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Says that this worker keeps something large between tasks, and how to let it go."""
    _held[name] = clear


def release() -> None:
    """Called where other work begins: workers live on from operator to operator, what they keep need not."""
    while _held:
        _held.popitem()[1]()

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 on each element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = _powers[key] = np.multiply.accumulate(have)
    return have


class Bytes(NamedTuple):
    """The bytes of some texts, one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> Bytes:
    """Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Bytes(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of ``column``; whole rows always."""
    ends = np.cumsum(np.diff(text_bytes(batch.column(column)).offsets)) if batch.num_rows else np.zeros(0)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Words(NamedTuple):
    """Words of some texts: 64-bit hashes, byte ranges, and the index of each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of codes, the same wherever the codes stand."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * _power(_BASE, n + 1, "up")[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n + 1, "down")[starts])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return run_hashes(_CODE[data], starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def words(texts: Bytes) -> Words:
    data = _LOWER[texts.data]
    inside = _IS_WORD[data]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, texts.offsets))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_STOP = np.zeros(256, dtype=bool)
_IS_STOP[[ord(c) for c in ".!?"]] = True


class Sentences(NamedTuple):
    """Byte ranges without the white space around, numbers of space-separated words, and each text's first sentence."""

    starts: np.ndarray
    ends: np.ndarray
    n_words: np.ndarray
    first: np.ndarray


def sentences(texts: Bytes) -> Sentences:
    """A sentence ends at a line break, or after ``.``, ``!`` or ``?`` where white space follows."""
    data, n = texts.data, len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, np.zeros(len(texts.offsets), np.int64))
    space = _IS_SPACE[data]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    cut = data == 10
    cut[1:] |= space[1:] & _IS_STOP[data[:-1]]
    cut[edges] = True
    begins_word = ~space
    begins_word[1:] &= space[:-1]
    begins_word[edges] = ~space[edges]
    visible = np.flatnonzero(~space)
    number = np.cumsum(cut)[visible]
    new = np.ones(len(visible), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    starts = visible[new]
    ends = visible[np.append(np.flatnonzero(new)[1:], len(visible)) - 1] + 1 if len(starts) else starts
    word_starts = np.flatnonzero(begins_word)
    # A cut may fall inside what spaces alone would call one word only at the edge of a text, where a word begins anew.
    counts = np.diff(np.append(np.searchsorted(word_starts, starts), len(word_starts)))
    return Sentences(starts, ends, np.maximum(counts, 1), np.searchsorted(starts, texts.offsets))


def spaced_words(texts: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of what stands between white space or the edges of a text."""
    visible = ~_IS_SPACE[texts.data]
    n = len(visible)
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    begins, stops = visible.copy(), visible.copy()
    begins[1:] &= ~visible[:-1]
    stops[:-1] &= ~visible[1:]
    begins[edges], stops[edges - 1] = visible[edges], visible[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def char_offsets(texts: Bytes, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Byte places as characters from the start of their text."""
    sums = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return sums[at] - sums[texts.offsets[text]]


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbouring hashes; there are len - k + 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total *= np.uint64(_BASE)
        total += hashes[j : j + n]
    return mix(total + np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))


def inside_texts(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether the k words from each of the n places stay within one text."""
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last
