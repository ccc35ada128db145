"""Texts of a batch in slices of bounded size; a text that is longer by itself comes in pieces cut at white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from barograph.llm import kernels

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bytes in pieces of at most ``size``, each but the last ending with white space; longer only where no white space is."""
    begin, n = 0, len(data)
    while n - begin > size:
        spaces = np.flatnonzero(_SPACE[data[begin : begin + size]])
        if len(spaces):
            end = begin + int(spaces[-1]) + 1
        else:
            end = begin + size
            while end < n and not len(spaces := np.flatnonzero(_SPACE[data[end : end + size]])):
                end += size
            end = min(n, end + int(spaces[0]) + 1) if len(spaces) else n
        yield data[begin:end]
        begin = end
    if begin < n:
        yield data[begin:]


def slices(batch: pa.RecordBatch, column: str, size: int = kernels.SLICE_BYTES) -> Iterator[tuple[int, int, Iterator[kernels.Bytes]]]:
    """(begin, end, texts): rows begin to end, with their texts at once, or one row with its text in pieces, one after the other."""
    row = 0
    for part in kernels.slices(batch, column, size):
        texts = kernels.text_bytes(part.column(column))
        if len(texts.data) > 2 * size:
            pieces = (kernels.Bytes(p, np.array([0, len(p)])) for p in cut(texts.data, size))
        else:
            pieces = iter([texts])
        yield row, row + part.num_rows, pieces
        row += part.num_rows
