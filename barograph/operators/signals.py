"""Wavelet details, phase lags and environments along a series. A series has a row a day, so one task sorts it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import ratio

#: The decomposition low-pass filter of the fourth Daubechies wavelet.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])
_HIGH = DB4[::-1] * np.where(np.arange(len(DB4)) % 2, 1, -1)


def _places(n: int) -> np.ndarray:
    """Which samples of a period n (even) each coefficient's filter meets."""
    starts = np.arange(len(DB4) // 2, n + len(DB4) // 2, 2)
    return (starts[:, None] - np.arange(len(DB4))[None, :]) % n


def _even(x: np.ndarray) -> np.ndarray:
    return x if len(x) % 2 == 0 else np.append(x, x[-1])


def wavelet_levels(n: int, wanted: int) -> int:
    """Levels that a series of n samples allows."""
    return max(0, min(wanted, int(np.floor(np.log2(n / (len(DB4) - 1)))) if n >= len(DB4) - 1 else 0))


def wavelet_bands(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Details of each level (levels, n), the finest first, and what is left: periodic bands that sum to x."""
    lengths, details, low = [], [], np.asarray(x, float)
    for _ in range(levels):
        lengths.append(len(low))
        even = _even(low)
        at = _places(len(even))
        details.append((even[at] * _HIGH).sum(axis=1))
        low = (even[at] * DB4).sum(axis=1)

    def up(c: np.ndarray, filter_: np.ndarray, level: int) -> np.ndarray:
        n = lengths[level] + lengths[level] % 2
        out = np.zeros(n)
        np.add.at(out, _places(n), c[:, None] * filter_)
        return out[: lengths[level]]

    def back(c: np.ndarray, filter_: np.ndarray, level: int) -> np.ndarray:
        c = up(c, filter_, level)
        for above in range(level - 1, -1, -1):
            c = up(c, DB4, above)
        return c

    bands = [back(d, _HIGH, level) for level, d in enumerate(details)]
    return np.array(bands).reshape(levels, len(x)), back(low, DB4, levels - 1) if levels else low


def wavelet_details(df: DataFrame, x: str, levels: int = 3, by: str = "symbol", least: int = 32) -> DataFrame:
    """Adds x_wd1, x_wd2, ...: the series' details, the finest first; null where it is shorter than ``least`` or allows fewer
    levels. A missing value counts as the one before (0 at first)."""
    names = [f"{x}_wd{i}" for i in range(1, levels + 1)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        values = pdf[x].ffill().fillna(0.0).to_numpy(float)
        n = wavelet_levels(len(values), levels) if len(values) >= least else 0
        bands, _ = wavelet_bands(values, n)
        return pdf.assign(**{name: bands[i] if i < n else np.nan for i, name in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(by).applyInPandas(run, fields + "".join(f", `{n}` double" for n in names))


def phase_lag(true: np.ndarray, pred: np.ndarray, most: float | None = None, low: float = 0.0, high: float | None = None) -> tuple[float, float, float]:
    """Lag of ``pred`` behind ``true`` in samples, slope and intercept: the line through the phase difference by frequency,
    weighted by power. Null values are interpolated."""
    if len(true) < 4:
        return np.nan, np.nan, np.nan
    spectra = []
    for y in (np.asarray(true, float), np.asarray(pred, float)):
        known = np.isfinite(y)
        y = y - y[known].mean() if known.any() else np.zeros(len(y))
        if not known.all():
            y = np.interp(np.arange(len(y)), np.flatnonzero(known), y[known]) if known.sum() > 1 else np.nan_to_num(y)
        spectra.append(np.fft.rfft(y))
    f = np.fft.rfftfreq(len(true))
    use = (f > max(low, 0.0)) & (f <= (high if high is not None else np.inf))
    if use.sum() < 2:
        return np.nan, np.nan, np.nan
    a, b = (s[use] for s in spectra)
    w = np.abs(a) ** 2 + np.abs(b) ** 2
    w = w if (w > 0).any() else np.ones(len(w))
    y, f = np.unwrap(np.angle(b) - np.angle(a)), f[use]
    fm, ym = np.average(f, weights=w), np.average(y, weights=w)
    spread = (w * (f - fm) ** 2).sum()
    slope = (w * (f - fm) * (y - ym)).sum() / spread if spread > 0 else 0.0
    lag = -slope / (2 * np.pi)
    return (float(np.clip(lag, -most, most)) if most is not None else float(lag)), float(slope), float(ym - slope * fm)


def phase_lags(df: DataFrame, true: str, pred: str, by: str = "symbol", most: float | None = None) -> DataFrame:
    """by, n, lag, slope, intercept of each series; null for fewer than four rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        lag, slope, intercept = phase_lag(pdf[true].to_numpy(float), pdf[pred].to_numpy(float), most)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(pdf)], "lag": [lag], "slope": [slope], "intercept": [intercept]})

    return df.groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, n bigint, lag double, slope double, intercept double")


def single_environment(df: DataFrame, action: str, price: str, by: str = "symbol", leverage: float = 1.0, bps: float = 10.0, risk: float = 0.01, scale: float = 1.0) -> DataFrame:
    """by, date, position, daily_ret, trade_cost, pnl_rate, reward, equity, bh_equity of one asset; the last row has no step.

    The position is the action within the leverage; the squared position counts in the reward and not in the equity.
    """
    w = Window.partitionBy(by).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.select(by, "date", F.greatest(F.lit(-leverage), F.least(F.lit(leverage), F.coalesce(action, F.lit(0.0)))).alias("position"), F.coalesce(ratio(F.lead(price).over(w), F.col(price)) - 1, F.lit(0.0)).alias("daily_ret"), F.lead("date").over(w).alias("_next"))
    df = df.withColumn("trade_cost", bps / 1e4 * F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))).where("_next is not null")
    df = df.withColumn("pnl_rate", F.col("position") * F.col("daily_ret") - F.col("trade_cost"))
    df = df.withColumn("reward", (F.col("pnl_rate") - risk * F.col("position") ** 2) * scale)
    return df.withColumns({"equity": F.exp(F.sum(F.log1p("pnl_rate")).over(so_far)), "bh_equity": F.exp(F.sum(F.log1p("daily_ret")).over(so_far))}).drop("_next")


def cash_environment(df: DataFrame, action: str, price: str, by: str = "symbol", cost: float = 0.001, cash: float = 1.0) -> DataFrame:
    """by, date, position, shares, cash, equity of a book that holds the action's share of its equity in the asset (short below 0).

    Each row it trades at the price to its target and pays ``cost`` of what it moves; so equity is what was left, moved by
    the held share of the price's change. The recursion of equity is a product, as costs are shares of it.
    """
    w = Window.partitionBy(by).orderBy("date")
    df = df.select(by, "date", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(action, F.lit(0.0)))).alias("position"), F.col(price).alias("_p"))
    last, held = F.lag("_p").over(w), F.coalesce(F.lag("position").over(w), F.lit(0.0))
    df = df.withColumns({"_grown": 1 + held * F.coalesce(ratio(F.col("_p"), last) - 1, F.lit(0.0)), "_drift": F.when(last.isNotNull(), held * ratio(F.col("_p"), last)).otherwise(F.lit(0.0))})
    # The share held before trading has drifted with the price.
    moved = F.abs(F.col("position") - ratio(F.col("_drift"), F.col("_grown")))
    df = df.withColumn("_factor", F.col("_grown") * (1 - cost * moved))
    df = df.withColumn("equity", cash * F.exp(F.sum(F.log("_factor")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return df.select(by, "date", "position", (F.col("position") * F.col("equity") / F.col("_p")).alias("shares"), ((1 - F.col("position")) * F.col("equity")).alias("cash"), "equity")


def advantages(df: DataFrame, reward: str, value: str, by: str = "agent", gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """by, date, advantage, target, scaled: generalised advantages of each series, from its end back.

    delta = reward + gamma * next value - value (the value after the end is 0), advantage = delta + gamma * lam * the next
    one's, target = advantage + value; ``scaled`` has mean 0 and deviation 1 over the series (0 where it does not vary).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        v = pdf[value].fillna(0.0).to_numpy(float)
        delta = pdf[reward].fillna(0.0).to_numpy(float) + gamma * np.append(v[1:], 0.0) - v
        out, last = np.zeros(len(v)), 0.0
        for t in range(len(v) - 1, -1, -1):
            last = delta[t] + gamma * lam * last
            out[t] = last
        sd = out.std()
        return pd.DataFrame({by: pdf[by], "date": pdf["date"], "advantage": out, "target": out + v, "scaled": (out - out.mean()) / (sd + 1e-8) if sd > 0 else np.zeros(len(out))})

    return df.groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, date date, advantage double, target double, scaled double")
