"""Bitmaps of a fixed size that tell which keys are worth shuffling; a set bit may be another key's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAGE = 1 << 12


def build(df: DataFrame, bit: Column, n_bits: int) -> bytes:
    """The bits ``bit`` (0 to n_bits - 1) of all rows; what reaches the driver is n_bits / 8 bytes, whatever the input."""
    at = bit.cast("long") + 1
    pages = df.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(max(_PAGE, n_bits // 8))
    for r in pages.collect():
        out[(r["page"] - 1) * _PAGE : r["page"] * _PAGE] = r["bits"]
    return bytes(out)


def test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the bits is set; ``bitmap``: its bytes."""
    at = at.astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def keep(df: DataFrame, bitmap: bytes, column: str) -> DataFrame:
    """The rows whose long ``column`` (a bit's number) is set. The bitmap travels with the tasks' code, not in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(test(bits, batch.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)
