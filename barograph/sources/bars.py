"""Daily bars, expert logs and forecasts, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.sources.tables import table


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: orders by priority and day, in order of their keys."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), p, k)
    return orders.groupBy("symbol", "date").agg(F.min_by(p, k).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, k).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


BARS_SQL = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


def experts(spark: SparkSession, folder: str) -> DataFrame:
    """agent, date, ratio in [-1, 1], ret, reward_next: line items by flag and status, and by ship date."""
    items = table(spark, folder, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("agent"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax")
    daily = items.groupBy("agent", "date").agg(F.round(F.avg("l_discount") * 20 - 1, 8).alias("ratio"), F.round(F.avg("l_tax") - 0.04, 8).alias("ret"))
    return daily.withColumn("reward_next", F.coalesce(F.lead("ret").over(Window.partitionBy("agent").orderBy("date")), F.lit(0.0)))


EXPERTS_SQL = """experts AS (
  SELECT *, coalesce(lead(ret) OVER (PARTITION BY agent ORDER BY date), 0.0) AS reward_next FROM (
    SELECT l_returnflag || l_linestatus AS agent, CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 20 - 1, 8) AS ratio, round(avg(l_tax) - 0.04, 8) AS ret
    FROM lineitem GROUP BY 1, 2))"""


def regimes(spark: SparkSession, folder: str) -> DataFrame:
    """date, regime_id: three bins of the market's number of orders a day."""
    days = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("date", (F.col("n") % 3).cast("int").alias("regime_id"))


REGIMES_SQL = "regimes AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) % 3 AS INTEGER) AS regime_id FROM orders GROUP BY 1)"

HORIZONS = (1, 5, 10, 20)


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, date, close and pred_01, pred_05, ...: closes expected that many rows ahead, from the mean of the last five."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)
    own = bars(spark, folder).withColumn("base", F.round(F.avg("close").over(w), 6))
    return own.select("symbol", "date", "close", *[F.round(F.col("base") * (1 + h / 1000), 6).alias(f"pred_{h:02d}") for h in HORIZONS])


FORECASTS_SQL = (
    "forecasts AS (SELECT symbol, date, close, "
    + ", ".join(f"round(base * (1 + {h} / 1000), 6) AS pred_{h:02d}" for h in HORIZONS)
    + " FROM (SELECT *, round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS base FROM bars))"
)
