"""Look-back tensors and targets of long series, split over tasks by ranges of positions.

Rows are dealt to ranges of their series; a range also gets the rows that its first windows reach back to and its last
targets look ahead to. So a task holds a range and its borders, never a whole series, and the result does not depend on how
many ranges there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.operators.positions import positions

MODES = ("close", "delta", "ret", "logret")
#: Rows of a range, borders aside.
RANGE = 4096
#: Logarithms of returns beyond this are cut before they are inverted.
MOST_LOG = 20.0


def target(ahead: Column, close: Column, mode: str) -> Column:
    """What a model learns of a later close; null unless both are above 0 (for ``close`` as it is)."""
    if mode == "close":
        return ahead
    both = (ahead > 0) & (close > 0)
    return F.when(both, {"delta": ahead - close, "ret": ahead / close - 1, "logret": F.log(ahead / close)}[mode])


def inverse(y: Column, close: Column, mode: str) -> Column:
    """The later close that a target stands for."""
    if mode == "close":
        return y
    cut = F.greatest(F.lit(-MOST_LOG), F.least(F.lit(MOST_LOG), y))
    return F.when((close > 0) & y.isNotNull(), {"delta": close + y, "ret": close * (1 + y), "logret": close * F.exp(cut)}[mode])


def _targets(ahead: np.ndarray, close: np.ndarray, mode: str) -> np.ndarray:
    if mode == "close":
        return ahead
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {"delta": ahead - close, "ret": ahead / close - 1, "logret": np.log(ahead / close)}[mode]
    return np.where((ahead > 0) & (close > 0), out, np.nan)


def windows(df: DataFrame, columns: list[str], close: str, steps: int, horizon: int, mode: str, by: str = "symbol", at: str = "date", rows: int = RANGE) -> DataFrame:
    """by, at, x, close, y of each row that has ``steps`` rows up to it: x has the rows by the columns, oldest first, in one list
    of fixed length (its shape is (steps, columns)); y has the targets of the next ``horizon`` rows, null where they are not known.

    Unknown and infinite inputs are 0. ``rows``: the length of a range.
    """
    kept = df.select(by, at, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(close).cast("double").alias("close"))
    placed = positions(kept, [at], [by], position="_at")
    ranges = F.sequence(F.floor((F.col("_at") - horizon) / rows), F.floor((F.col("_at") + steps - 1) / rows))
    dealt = placed.withColumn("_range", F.explode(F.filter(ranges, lambda r: r >= 0)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at_ = table["_at"].to_numpy()
        own = np.flatnonzero(at_ // rows == table["_range"][0].as_py())
        own = own[at_[own] >= steps - 1]
        x = np.stack([table[f"x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)
        price = np.append(table["close"].to_numpy(zero_copy_only=False).astype(float), np.full(horizon, np.nan))
        stacked = x[own[:, None] + np.arange(-(steps - 1), 1)].reshape(len(own), steps * len(columns))
        ahead = _targets(price[own[:, None] + np.arange(1, horizon + 1)], price[own][:, None], mode)
        lists = lambda a, t: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), t, from_pandas=True), max(1, a.shape[1])).cast(pa.list_(t))
        return pa.table({by: table[by].take(own), at: table[at].take(own), "x": lists(stacked, pa.float32()), "close": table["close"].take(own), "y": lists(ahead, pa.float64())})

    return dealt.groupBy(by, "_range").applyInArrow(run, f"{by} {kinds[by]}, {at} {kinds[at]}, x array<float>, close double, y array<double>")
