"""Snapshots, markers, contracts, policies, positions and fitted regimes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.operators import policies as po
from barograph.operators import regime_fit as rf
from barograph.operators import tensors as tn
from barograph.operators.positions import align, positions
from barograph.plans.registry import query, r, rounded
from barograph.sources import contracts as co
from barograph.sources import snapshots as sn
from barograph.sources.bars import bars, experts
from barograph.sources.tables import materialize, shared_folder
from barograph.streaming import markers as mk

KEY = ["symbol", "date"]


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_LOOKBACK, _MONTHS = 30, 3
_SETS = f"""days AS (SELECT date, count(*) AS n FROM bars GROUP BY 1),
  placed AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS row FROM bars),
  sets AS (
    SELECT 'prices' AS kind, date, n FROM days UNION ALL SELECT 'features', date, n FROM days
    UNION ALL SELECT 'window', date, CAST(sum(least(row, {_LOOKBACK})) AS BIGINT) FROM placed GROUP BY 2
    UNION ALL SELECT 'future', d.date, count(*) FROM days d JOIN days c ON c.date > d.date AND c.date <= d.date + INTERVAL {_MONTHS} MONTH GROUP BY 2)"""


def _snapshots(spark: SparkSession, d: str) -> str:
    own = bars(spark, d).select(*KEY, "open", "close", (F.col("close") / F.col("open") - 1).alias("gain"))
    rows = sn.daily_sets(own, ["open", "close"], ["gain"], own.select("date"), {"weekday": F.weekday("at")}, _LOOKBACK, _MONTHS)
    place = _place(spark, "snapshots")
    sn.write(rows, place, {"prices": ["symbol", "at", "open", "close"], "features": ["symbol", "at", "gain", "weekday"], "future": ["at", "weekday"]})
    return place


@query("SELECT kind, date, n AS n_rows FROM sets", more=_SETS)
def sink_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest says of each kind and date."""
    return sn.manifest(spark, _snapshots(spark, d)).groupBy("kind", "date").agg(F.sum("rows").alias("n_rows"))


@query(f"SELECT date AS snapshot, symbol, n, round(total, 2) + 0.0 AS total, oldest FROM (SELECT symbol, date, count(*) OVER w AS n, sum(close) OVER w AS total, first_value(date) OVER w AS oldest FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {_LOOKBACK - 1} PRECEDING AND CURRENT ROW))")
def sink_daily_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The look-back windows of every date and symbol, read back from their files."""
    window = sn.read(spark, _snapshots(spark, d), "window", "symbol string, at date, open double, close double, gain double, weekday int")
    return rounded(window.groupBy("snapshot", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"), F.min("at").alias("oldest")), "total", digits=2)


@query("SELECT CAST(date_trunc('month', date) AS DATE) AS day, count(*) AS n_bars, 'm' || strftime(date_trunc('month', date), '%Y%m') AS hash FROM bars GROUP BY 1, 3")
def stream_ready_markers(spark: SparkSession, d: str) -> DataFrame:
    """A marker for each month of bars: every third fails first and comes late, each is written twice; a stream joins them with the bars."""
    folder, place = _place(spark, "markers"), _place(spark, "ready")
    own = materialize(bars(spark, d).select(F.trunc("date", "month").alias("day"), "symbol"), "months")
    months = [x["day"] for x in own.select("day").distinct().orderBy("day").collect()]  # a row a month
    write = lambda m, status: mk.write_marker(folder, f"month-{m:%Y-%m}", status, str(m), f"m{m:%Y%m}")
    for late in (False, True):
        for i, m in enumerate(months):
            write(m, "READY" if late or i % 3 else "FAILED")
        query_ = mk.ready_days(spark, folder, f"{place}/journal").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query_.awaitTermination()
    ready = spark.read.schema(f"{mk.SCHEMA}, key string").parquet(f"{place}/out")
    return ready.join(own, "day").groupBy("day", "hash").agg(F.count(F.lit(1)).alias("n_bars"))


@query("""SELECT 'close below high' AS rule, count(*) FILTER (WHERE NOT coalesce(close <= high, false)) AS n_broken FROM bars UNION ALL
  SELECT 'gains of less than half', count(*) FILTER (WHERE NOT coalesce(abs(close / open - 1) < 0.5, false)) FROM bars UNION ALL SELECT 'least_rows', 0 UNION ALL SELECT 'distinct_key', 0 UNION ALL SELECT 'published', 0""")
def audit_contract(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the bars, counted as they are written; the table is not published (0 places) as long as any is."""
    contract = co.Contract(("symbol", "date", "close"), {"close below high": F.col("close") <= F.col("high"), "gains of less than half": F.abs(F.col("close") / F.col("open") - 1) < 0.5}, least_rows=10, key=("symbol", "date"))
    report = co.write_checked(bars(spark, d), _place(spark, "contract"), contract)
    return spark.createDataFrame([*report.broken.items(), ("published", int(report.place is not None))], "rule string, n_broken bigint")


#: Agents with a policy; the others have none, and act 0.
_AGENTS = ("AF", "NF", "NO")


def _policies() -> dict[str, po.Policy]:
    def weights(i: int) -> po.Policy:
        first = np.array([[((i + 1) * (j + 1) + k) / 10 - 0.3 for k in range(3)] for j in range(2)])
        return po.Policy([(first, np.array([0.0, 0.1])), (np.array([[0.5, 0.3]]), np.array([0.05 * i]))], np.array([0.1, 0.0, 0.0]), np.array([0.5, 0.02, 1.0]))

    return {a: weights(i) for i, a in enumerate(_AGENTS)}


_H = "tanh(" + " + ".join(f"(((i + 1) * {{j}} + {k}) / 10 - 0.3) * o{k}" for k in range(3)) + " + {b})"


@query(f"""SELECT agent, date, CASE WHEN i IS NULL THEN 0.0 ELSE round(greatest(-0.8, least(0.8, tanh(0.5 * {_H.format(j=1, b=0.0)} + 0.3 * {_H.format(j=2, b=0.1)} + 0.05 * i))), 6) + 0.0 END AS action, CASE WHEN i IS NULL THEN 'no policy' END AS problem FROM (
  SELECT agent, date, (ratio - 0.1) / 0.5 AS o0, ret / 0.02 AS o1, coalesce(lag(ratio) OVER (PARTITION BY agent ORDER BY date), 0.0) AS o2, CASE agent WHEN 'AF' THEN 0 WHEN 'NF' THEN 1 WHEN 'NO' THEN 2 END AS i FROM experts)""", uses=("experts",))
def policy_actions(spark: SparkSession, d: str) -> DataFrame:
    """Two-layer policies on each agent's ratio, return and last position; one agent's is missing."""
    df = experts(spark, d).withColumn("before", F.lag("ratio").over(Window.partitionBy("agent").orderBy("date")))
    path = po.save(spark, _policies(), f"{_place(spark, 'policies')}.npz")
    return rounded(po.act(df, "agent", ["ratio", "ret", "before"], path, limit=0.8).select("agent", "date", "action", "problem"), "action")


@query("SELECT symbol, date, close, row_number() OVER (ORDER BY close DESC, symbol, date) - 1 AS position, row_number() OVER (PARTITION BY symbol ORDER BY close, date) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM bars")
def sort_stable(spark: SparkSession, d: str) -> DataFrame:
    """Every bar's position by close over the whole table, and within its symbol, without a task that has them all."""
    everywhere = positions(bars(spark, d).select(*KEY, "close"), ["close", *KEY], descending=("close",))
    return positions(everywhere, ["close", "date"], ["symbol"], position="place", total="n")


@query(f"""SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.i, b.i) AS position, a.date, {r('a.close').replace('AS a.close', 'AS close')}, b.date AS date_right, {r('b.pred_05').replace('AS b.pred_05', 'AS pred_05_right')}
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM forecasts WHERE pred_05 > close) b ON a.symbol = b.symbol AND a.i = b.i""", uses=("bars", "forecasts"))
def positional_align(spark: SparkSession, d: str) -> DataFrame:
    """Bars beside the forecasts of a rise by their order alone, so the shorter series ends in nulls."""
    from barograph.sources.bars import forecasts

    rises = forecasts(spark, d).where("pred_05 > close").select(*KEY, "pred_05")
    return rounded(align(bars(spark, d).select(*KEY, "close"), rises, ["date"], ["symbol"]), "close", "pred_05_right")


@query()
def arr_ticc_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fine and stable regimes of the bars' gains and volumes over two days, fitted on the years before 1997."""
    own = bars(spark, d).select(*KEY, F.log(F.col("close") / F.col("open")).alias("gain"), F.log("volume").alias("volume"))
    rows = rf.stacked(own, ["gain", "volume"], 2).withColumn("train", F.col("date") < F.lit("1997-01-01").cast("date"))
    return rf.fit_two_levels(rows, "train", 6, 2, penalty=4.0, rounds=12)


_T, _H = 20, 5
_MODES = "".join(f", round({y}, 8) + 0.0 AS y_{m}" for m, y in (("close", "c5"), ("delta", "c5 - close"), ("ret", "c5 / close - 1"), ("logret", "ln(c5 / close)")))


@query(f"""SELECT symbol, date, CAST(2 * {_T} AS INTEGER) AS n, oldest, round(volumes, 2) + 0.0 AS volumes{_MODES}, round(c5, 4) + 0.0 AS back FROM (
  SELECT symbol, date, close, row_number() OVER w AS i, CAST(lag(close, {_T - 1}) OVER w AS FLOAT) AS oldest, sum(volume) OVER (w ROWS BETWEEN {_T - 1} PRECEDING AND CURRENT ROW) AS volumes, lead(close, {_H}) OVER w AS c5
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE i >= {_T}""")
def arr_window_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Tensors of closes and volumes over 20 bars and the four kinds of targets, in ranges of 500 rows; what each target stands for."""
    out, own = None, materialize(bars(spark, d).select(*KEY, "close", "volume"), "bars")
    for mode in tn.MODES:
        part = tn.windows(own, ["close", "volume"], "close", _T, _H, mode, rows=500).withColumn(f"y_{mode}", F.col("y")[_H - 1])
        part = part.withColumn(f"back_{mode}", F.round(tn.inverse(F.col(f"y_{mode}"), F.col("close"), mode), 4) + F.lit(0.0))
        first = part.select(*KEY, F.size("x").alias("n"), F.col("x")[0].alias("oldest"), F.aggregate(F.transform(F.filter("x", lambda v, i: i % 2 == 1), lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v).alias("volumes"), f"y_{mode}", f"back_{mode}")
        out = first if out is None else out.join(part.select(*KEY, f"y_{mode}", f"back_{mode}"), KEY)
    # One column, as all four must stand for the same close.
    backs = F.array_distinct(F.array(*[F.col(f"back_{m}") for m in tn.MODES]))
    out = out.withColumn("back", F.when(F.size(backs) == 1, backs[0]).otherwise(F.raise_error(F.lit("targets differ")).cast("double")))
    return rounded(rounded(out.drop(*[f"back_{m}" for m in tn.MODES]), *[f"y_{m}" for m in tn.MODES], digits=8), "volumes", digits=2)
