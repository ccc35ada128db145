"""Encoding of whole texts with a byte-level BPE of the tokenizers library.

Such a tokenizer never joins characters across a space that a visible character follows, nor a letter and a mark after
it, nor a line break and what is visible before and after it. Cut there, a text is a sequence of units. Units repeat far
more often than texts: Arrow finds the distinct ones of some texts and puts their ids together again, and each worker
encodes a unit once and keeps its ids, within a limit. The ids are those that the library gives for the whole text.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa

from barograph.llm import kernels

#: Units that a worker keeps in each of two generations; what the older one gives moves to the younger.
CACHE_UNITS = 700_000
_GROUP = 4096
_BYTES = np.arange(256)
_BLANK = (_BYTES > 8) & (_BYTES < 14) | (_BYTES > 27) & (_BYTES < 33)
_VISIBLE = (_BYTES > 32) & (_BYTES < 127)
_LETTER = np.isin(_BYTES, list(string.ascii_letters.encode()))


def unit_starts(data: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the units of some UTF-8 texts begin; text i, not empty, ends at ends[i]. ``marks``: whether a byte is a mark that may follow a letter in another unit.

    A space before bytes that may be a white space begins none.
    """
    near = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(2, np.uint8)])
    before, one, two = near[:-3], near[2:-1], near[3:]
    at = np.flatnonzero(data == 32)
    b, c = one[at], two[at]
    blank = _BLANK[b] | (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (b == 0xE1) & (c == 0x9A) | (b == 0xE2) & (c <= 0x81) | (b == 0xE3) & (c == 0x80)
    starts = marks[data] & _LETTER[before]
    starts[at[~blank]] = True
    starts[ends - 1] &= data[ends - 1] != 32
    lines = np.flatnonzero(data == 10)
    lines = lines[_VISIBLE[before[lines]]]
    starts[lines] = True
    starts[lines[_VISIBLE[one[lines]]] + 1] = True
    starts[ends[:-1]] = True
    starts[:1] = True
    return np.flatnonzero(starts)


class Encoder:
    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(size, dtype=bool)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.spaced[i] = token.startswith("Ġ")  # how byte-level vocabularies write a space
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = set("".join(t.content for t in self.model.get_added_tokens_decoder().values()))
        self.marks = np.isin(_BYTES, [ord(c) for c in string.punctuation if c not in added])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Units that a space begins, and that hold no other, are encoded as one text: their first ids show where they begin."""
        plain = [u for u in units if u.rfind(" ") == 0]
        other = [u for u in units if u.rfind(" ") != 0]
        self.known.update(zip(other, self._whole(other), strict=True))
        for at in range(0, len(plain), _GROUP):
            group = plain[at : at + _GROUP]
            ids = np.array(self.model.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) != len(group):
                self.known.update(zip(group, self._whole(group), strict=True))
                continue
            data, width = ids.tobytes(), self.dtype.itemsize
            edges = [*(cuts * width).tolist(), len(data)]
            self.known.update(zip(group, [data[a:b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """The ids of different units."""
        if len(self.known) > CACHE_UNITS:
            self.older, self.known = self.known, {}
        known = self.known
        new = [u for u in units if u not in known]
        if self.older:
            old = list(map(self.older.get, new))
            known.update((u, ids) for u, ids in zip(new, old, strict=True) if ids is not None)
            new = [u for u, ids in zip(new, old, strict=True) if ids is None]
        self._learn(new)
        return list(map(known.__getitem__, units))

    def encode_column(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts as little-endian numbers of ``dtype``, an end id after each text's, and where each text's end (in ids)."""
        text = kernels.text_bytes(texts)
        ends = text.offsets[1:].astype(np.int64)
        starts = unit_starts(text.data, ends[np.diff(text.offsets) > 0], self.marks)
        edges = np.append(starts, len(text.data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(text.data)).dictionary_encode()
        ids = pa.array([*self._ids_of(units.dictionary.to_numpy(zero_copy_only=False).tolist()), self.end], pa.binary())
        counts = np.searchsorted(starts, ends)  # of units, up to each text's end
        order = np.insert(units.indices.to_numpy(), counts, len(ids) - 1)
        got = ids.cast(pa.large_binary()).take(pa.array(order))
        _, offsets, data = got.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(got) + 1]
        return data.to_pybytes() if data else b"", edges[counts + np.arange(1, len(ends) + 1)] // self.dtype.itemsize

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, and the end id, as little-endian numbers of ``dtype``."""
        data, ends = self.encode_column(pa.array(texts, pa.string()))
        edges = [0, *(ends * self.dtype.itemsize).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=1)
def worker_encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's own: the tasks that it runs one after the other share what it knows."""
    kernels.hold("encoder", worker_encoder.cache_clear)
    return Encoder(path, end_id)
