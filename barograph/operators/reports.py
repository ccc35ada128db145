"""Metrics of daily logs as reports give them, with fallbacks: which rows count, and returns where only equity is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import ratio

YEAR = 252
#: A position of at most this counts as none.
FLAT = 0.01


def test_rows(df: DataFrame, by: list[str], test_start: str | None = None) -> DataFrame:
    """The rows of each log that count, and ``basis``: those with split test (trimmed, in any case) if there is one; else those from ``test_start`` on; else all."""
    is_test = F.coalesce(F.lower(F.trim("split")) == "test", F.lit(False))
    df = df.withColumn("_any", F.max(is_test).over(Window.partitionBy(*by)))
    late = F.lit(True) if test_start is None else F.coalesce(F.col("date") >= F.lit(test_start).cast("date"), F.lit(False))
    basis = F.when(F.col("_any"), "split=test").otherwise("all_rows" if test_start is None else f"date>={test_start}")
    return df.withColumn("basis", basis).where(F.when(F.col("_any"), is_test).otherwise(late)).drop("_any")


def report(df: DataFrame, by: list[str], test_start: str | None = None) -> DataFrame:
    """by, basis, derived, test_days, total_return_pct, max_dd_pct, avg_daily_ret, win_rate, sharpe, vol_annual, avg_hold_days of each log (by, date, split, ret, equity, ratio).

    Return and drawdown are the known equity's. A log without any return gets them from its equity (``derived``), to 12 digits, so that an equity that stays gives no gain. A deviation
    of 0 gives no Sharpe ratio; days without a position none to hold. A log none of whose rows count has 0 test days.
    """
    rows = test_rows(df, by, test_start)
    w, whole = Window.partitionBy(*by).orderBy("date"), Window.partitionBy(*by)
    known = F.col("equity").isNotNull()
    before = F.last(F.when(known, F.col("equity")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_derived": F.count("ret").over(whole) == 0, "_from": F.when(known, F.round(ratio(F.col("equity"), before) - 1, 12)), "_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_r", F.when(F.col("_derived"), F.col("_from")).otherwise(F.col("ret")))
    held = F.abs(F.coalesce("ratio", F.lit(0.0))) > FLAT
    rows = rows.withColumn("_held", held).withColumn("_run", F.sum((~F.col("_held")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("_held").groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.avg("_n").alias("avg_hold_days"))
    ends = rows.where(known).groupBy(*by).agg(F.min_by("equity", "date").alias("_e0"), F.max_by("equity", "date").alias("_e1"), F.count(F.lit(1)).alias("_ne"), F.min(ratio(F.col("equity"), F.col("_peak")) - 1).alias("_dd"))
    m = rows.groupBy(*by).agg(F.first("basis").alias("basis"), F.max("_derived").alias("_none"), F.count(F.lit(1)).alias("test_days"), F.avg("_r").alias("avg_daily_ret"), F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))).alias("win_rate"), F.stddev_samp("_r").alias("_sd"))
    m = df.select(*by).distinct().join(m, by, "left").join(ends, by, "left").join(runs, by, "left")
    two = F.coalesce((F.col("_ne") >= 2) & (F.col("_e0") != 0), F.lit(False))
    return m.select(
        *by, "basis", F.coalesce(F.col("_none") & (F.col("_ne") >= 2), F.lit(False)).alias("derived"), F.coalesce("test_days", F.lit(0)).alias("test_days"),
        F.when(two, (F.col("_e1") / F.col("_e0") - 1) * 100).alias("total_return_pct"), F.when(two, F.col("_dd") * 100).alias("max_dd_pct"),
        "avg_daily_ret", "win_rate", F.when(F.col("_sd") > 0, F.col("avg_daily_ret") / F.col("_sd") * YEAR**0.5).alias("sharpe"), (F.col("_sd") * YEAR**0.5).alias("vol_annual"), "avg_hold_days",
    )
