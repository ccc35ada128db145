"""Joins, filters, projections, splits, fills and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.windows import fill_both
from barograph.operators import horizons as hz
from barograph.operators import relational as rel
from barograph.plans.registry import W, query, r, rounded
from barograph.sources.bars import bars, experts, forecasts, regimes
from barograph.sources.tables import table

KEY = ["symbol", "date"]


@query("SELECT symbol, date, close, volume FROM bars")
def proj_prefix(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    return df.select(*KEY, *[c for c in df.columns if c.startswith(("clos", "vol"))])


@query("SELECT symbol, date, pred_01 AS h01, pred_05 * 2 AS h05, pred_20 AS h20 FROM forecasts", uses=("bars", "forecasts"))
def proj_horizon_parse(spark: SparkSession, d: str) -> DataFrame:
    """Columns of several writers' names; of two for one horizon the scaled one counts, those of another model do not."""
    p = {c: F.col(c) for c in ("pred_01", "pred_05", "pred_20")}
    names = {"Pred_Close_h01": p["pred_01"], "Close_pred_h05": p["pred_05"], "Pred_Close_scaled_h05": p["pred_05"] * 2, "pred_close_t_plus_20": p["pred_20"], "pred_close_other_h20": p["pred_01"], "close_h30": p["pred_01"], "pred_close": p["pred_01"]}
    df = forecasts(spark, d).select(*KEY, *[x.alias(n) for n, x in names.items()])
    found = hz.horizon_columns(df.columns, without=("other",))
    return df.select(*KEY, *[F.col(c).alias(f"h{h:02d}") for h, c in found.items()])


@query("SELECT symbol, date, close, CAST(0 AS DOUBLE) AS per_week, CAST(1 AS INTEGER) AS n_placeholders FROM bars")
def proj_defensive_fill(spark: SparkSession, d: str) -> DataFrame:
    df, wanted = bars(spark, d), ["close", "per_week"]
    missing = [c for c in wanted if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}).select(*KEY, *wanted, F.lit(len(missing)).alias("n_placeholders"))


@query("SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).where(F.col("date").between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select(*KEY, "close")


@query("SELECT symbol, date, close FROM bars WHERE date <= DATE '1994-06-30'")
def filter_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).where(F.col("date") <= F.lit("1994-06-30").cast("date")).select(*KEY, "close")


TRAIN, TEST = ("1993-01-01", "1996-12-31"), ("1996-10-01", "1997-12-31")
_SPLIT = "CASE WHEN date BETWEEN DATE '1996-10-01' AND DATE '1997-12-31' THEN 'test' WHEN date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' THEN 'train' ELSE 'other' END"


@query(f"SELECT symbol, date, {_SPLIT} AS split FROM bars")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select(*KEY, rel.split_assign(F.col("date"), TRAIN, TEST).alias("split"))


@query(f"SELECT symbol, date, close FROM (SELECT *, {_SPLIT} AS split FROM bars) WHERE lower(split) = 'test'")
def filter_split(spark: SparkSession, d: str) -> DataFrame:
    split = rel.split_assign(F.col("date"), TRAIN, TEST)
    return bars(spark, d).where(F.lower(split) == "test").select(*KEY, "close")


@query("""SELECT symbol, min(date) FILTER (date >= tr) AS train_start, max(date) FILTER (date < te) AS train_end, min(date) FILTER (date >= te) AS test_start, test_end
  FROM (SELECT *, CAST(test_end - INTERVAL 3 MONTH AS DATE) AS te, CAST(test_end - INTERVAL 27 MONTH AS DATE) AS tr FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS test_end FROM bars)) GROUP BY symbol, test_end""")
def split_windows(spark: SparkSession, d: str) -> DataFrame:
    return rel.split_windows(bars(spark, d))


_ISLAND = """island AS (SELECT l.symbol, CASE WHEN n > 1 THEN start ELSE mid END AS test_start FROM (
    SELECT symbol, arg_max(start, run) AS start, arg_max(n, run) AS n FROM (SELECT symbol, run, min(date) AS start, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN date - p <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS run FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars)) GROUP BY 1, 2) GROUP BY symbol) l
  JOIN (SELECT symbol, a[len(a) // 2 + 1] AS mid FROM (SELECT symbol, list_sort(list(date)) AS a FROM bars GROUP BY symbol)) m ON l.symbol = m.symbol)"""
_RESOLVED = "SELECT '{how}' AS how, symbol, {source} AS split_source, {split} AS split, count(*) AS n FROM {rows} GROUP BY ALL"


@query(" UNION ALL ".join((
    _RESOLVED.format(how="column", source="'csv'", split=f"lower({_SPLIT})", rows="bars"),
    _RESOLVED.format(how="summary", source="'summary'", split="CASE WHEN date >= DATE '1996-10-01' THEN 'test' ELSE 'train' END", rows="bars"),
    _RESOLVED.format(how="dates", source="'date_infer'", split="CASE WHEN date >= test_start THEN 'test' ELSE 'train' END", rows="bars JOIN island USING (symbol)"),
    _RESOLVED.format(how="none", source="'fallback_all_test'", split="'test'", rows="bars"),
)), more=_ISLAND)
def split_resolve(spark: SparkSession, d: str) -> DataFrame:
    """All four ways: a column, the summary's day, the dates alone, and no date at all."""
    df = bars(spark, d).select(*KEY)
    ways = {
        "column": rel.resolve_split(df.withColumn("split", F.concat(F.lit(" "), F.upper(rel.split_assign(F.col("date"), TRAIN, TEST))))),
        "summary": rel.resolve_split(df, TEST[0]),
        "dates": rel.resolve_split(df),
        "none": rel.resolve_split(df.withColumn("date", F.lit(None).cast("date"))),
    }
    one = lambda how, x: x.groupBy("symbol", "split_source", "split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "symbol", "split_source", "split", "n")
    out = None
    for how, x in ways.items():
        out = one(how, x) if out is None else out.unionByName(one(how, x))
    return out


@query("SELECT symbol, date, close FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH')")
def filter_isin(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).where(F.col("symbol").isin("1-URGENT", "2-HIGH")).select(*KEY, "close")


@query("SELECT symbol, date, round(ln(volume - 1), 6) + 0.0 AS x FROM bars WHERE volume > 1")
def pred_finite(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("volume") > 1, F.log(F.col("volume") - 1))
    df = bars(spark, d).select(*KEY, x.alias("x"))
    return rounded(df.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))), "x")


@query("""SELECT agent, date, abs(ratio) <= 0.05 OR ret <= -0.03 OR 1 - ret >= 1.03 AS boundary,
  array_to_string(list_filter([CASE WHEN abs(ratio) <= 0.05 THEN 'margin' END, CASE WHEN ret <= -0.03 THEN 'low' END], lambda x: x IS NOT NULL), '|') AS flags FROM experts""", uses=("experts",))
def pred_boundary(spark: SparkSession, d: str) -> DataFrame:
    near, low = F.abs("ratio") <= 0.05, F.col("ret") <= -0.03
    flags = F.array_compact(F.array(F.when(near, "margin"), F.when(low, "low")))
    return experts(spark, d).select("agent", "date", (near | low | (1 - F.col("ret") >= 1.03)).alias("boundary"), F.array_join(flags, "|").alias("flags"))


@query("SELECT b.symbol, b.date, b.close, f.close AS close_r, f.pred_05 FROM bars b LEFT JOIN forecasts f ON b.symbol = f.symbol AND b.date = f.date", uses=("bars", "forecasts"))
def join_left_features(spark: SparkSession, d: str) -> DataFrame:
    return rel.join_features(bars(spark, d).select(*KEY, "close"), forecasts(spark, d).select(*KEY, "close", "pred_05"), KEY)


@query("SELECT x.date, x.close AS a, y.close AS b FROM bars x JOIN bars y ON x.date = y.date AND x.symbol = '1-URGENT' AND y.symbol = '2-HIGH'")
def join_inner_pair(spark: SparkSession, d: str) -> DataFrame:
    return rel.pair(bars(spark, d), "1-URGENT", "2-HIGH")


_GAPS = "SELECT symbol, date, nullif({c}, round({c})) AS {c} FROM forecasts"


@query(f"SELECT a.symbol, a.date, pred_01, pred_05 FROM ({_GAPS.format(c='pred_01')}) a FULL JOIN ({_GAPS.format(c='pred_05')}) b ON a.symbol = b.symbol AND a.date = b.date WHERE a.symbol IS NOT NULL UNION ALL SELECT 'only ' || symbol, date, NULL, pred_05 FROM ({_GAPS.format(c='pred_05')})", uses=("bars", "forecasts"))
def join_outer_horizons(spark: SparkSession, d: str) -> DataFrame:
    """A horizon of which some values are missing, and one that also has symbols of its own."""
    f = forecasts(spark, d)
    gaps = lambda c: f.select(*KEY, F.nullif(F.col(c), F.round(c)).alias(c))
    more = gaps("pred_05").withColumn("symbol", F.concat(F.lit("only "), "symbol"))
    return rel.outer_all([gaps("pred_01"), gaps("pred_05").unionByName(more)], KEY)


@query("SELECT symbol, date, CASE WHEN day(date) % 4 > 0 THEN close ELSE open END AS x FROM bars UNION ALL SELECT 'only ' || symbol, date, open FROM bars")
def join_combine_first(spark: SparkSession, d: str) -> DataFrame:
    """Closes of which some are null, filled from opens; the opens also have symbols of their own."""
    df = bars(spark, d)
    a = df.select(*KEY, F.when(F.day("date") % 4 > 0, F.col("close")).alias("x"))
    b = df.select(*KEY, F.col("open").alias("x"))
    return rel.combine_first(a, b.unionByName(b.withColumn("symbol", F.concat(F.lit("only "), "symbol"))), KEY)


@query("SELECT c.date, f.pred_10 FROM (SELECT DISTINCT date FROM bars) c LEFT JOIN (SELECT date, pred_10 FROM forecasts WHERE symbol = '5-LOW') f ON c.date = f.date", uses=("bars", "forecasts"))
def join_left_calendar(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("date").distinct().join(forecasts(spark, d).where("symbol = '5-LOW'").select("date", "pred_10"), "date", "left")


@query("SELECT r.date, r.regime_id, b.symbol, b.close, e.ratio FROM regimes r JOIN bars b ON r.date = b.date LEFT JOIN (SELECT date, ratio FROM experts WHERE agent = 'NO') e ON r.date = e.date", uses=("bars", "experts", "regimes"))
def join_three_way(spark: SparkSession, d: str) -> DataFrame:
    chosen = experts(spark, d).where("agent = 'NO'").select("date", "ratio")
    return regimes(spark, d).join(bars(spark, d).select("date", "symbol", "close"), "date").join(chosen, "date", "left")


@query(f"SELECT e.agent, e.date, e.split, m.mean_ratio FROM (SELECT *, {_SPLIT} AS split FROM experts) e LEFT JOIN (SELECT date, split, round(avg(ratio), 6) + 0.0 AS mean_ratio FROM (SELECT *, {_SPLIT} AS split FROM experts) WHERE ratio > 0 GROUP BY 1, 2) m ON e.date = m.date AND e.split = m.split", uses=("experts",))
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    e = experts(spark, d).withColumn("split", rel.split_assign(F.col("date"), TRAIN, TEST))
    m = rounded(e.where("ratio > 0").groupBy("date", "split").agg(F.avg("ratio").alias("mean_ratio")), "mean_ratio")
    return e.select("agent", "date", "split").join(m, ["date", "split"], "left")


@query("SELECT DISTINCT a.agent, r.regime_id FROM (SELECT DISTINCT agent FROM experts) a, (SELECT DISTINCT regime_id FROM regimes) r", uses=("experts", "regimes"))
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    few = regimes(spark, d).agg(F.collect_set("regime_id").alias("ids"))  # three regimes
    return experts(spark, d).select("agent").distinct().join(few).select("agent", F.explode("ids").alias("regime_id"))


@query("SELECT agent, date, ret FROM experts WHERE date IN (SELECT date FROM bars WHERE symbol = '1-URGENT')", uses=("bars", "experts"))
def join_semi_dates(spark: SparkSession, d: str) -> DataFrame:
    return experts(spark, d).join(bars(spark, d).where("symbol = '1-URGENT'"), "date", "left_semi").select("agent", "date", "ret")


@query("SELECT agent, date, ret FROM experts WHERE date NOT IN (SELECT date FROM bars WHERE symbol = '1-URGENT')", uses=("bars", "experts"))
def join_anti_dates(spark: SparkSession, d: str) -> DataFrame:
    return experts(spark, d).join(bars(spark, d).where("symbol = '1-URGENT'"), "date", "left_anti").select("agent", "date", "ret")


@query("""SELECT c.c_custkey, c.day, coalesce(max(b.date) FILTER (b.date <= c.day), min(b.date)) AS snapped FROM (SELECT c_custkey, DATE '1995-01-01' + CAST(c_custkey % 900 AS INTEGER) AS day FROM customer) c, (SELECT date FROM bars WHERE symbol = '3-MEDIUM') b GROUP BY 1, 2""")
def join_asof_floor(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "customer").select("c_custkey", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("date"), F.lit("3-MEDIUM").alias("symbol"))
    known = bars(spark, d).where("symbol = '3-MEDIUM'").select("symbol", "date", "close")
    first = known.agg(F.min("date").alias("first"))
    out = rel.asof(days, known, "date", ["symbol"], ["close"])
    return out.join(F.broadcast(first)).select("c_custkey", F.col("date").alias("day"), F.coalesce("matched_on", "first").alias("snapped"))  # one row


@query("SELECT e.agent, e.date, p.close AS prev_close, p.date AS prev_date FROM experts e ASOF LEFT JOIN (SELECT date, close FROM bars WHERE symbol = '1-URGENT') p ON e.date > p.date", uses=("bars", "experts"))
def join_asof_prev_row(spark: SparkSession, d: str) -> DataFrame:
    left = experts(spark, d).select("agent", "date", F.lit("1-URGENT").alias("symbol"))
    out = rel.asof(left, bars(spark, d).where("symbol = '1-URGENT'"), "date", ["symbol"], ["close"], strict=True)
    return out.select("agent", "date", F.col("close").alias("prev_close"), F.col("matched_on").alias("prev_date"))


@query("SELECT o.o_orderkey, coalesce(p.close, 20.0) AS price FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS day, o_orderpriority FROM orders) o ASOF LEFT JOIN bars p ON o.o_orderpriority = p.symbol AND o.day >= p.date")
def join_asof_price(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), 30).alias("date"), F.col("o_orderpriority").alias("symbol"))
    return rel.asof(left, bars(spark, d), "date", ["symbol"], ["close"]).select("o_orderkey", F.coalesce("close", F.lit(20.0)).alias("price"))


_IV = """iv AS (SELECT symbol, run AS id, any_value(CASE WHEN up THEN 'UP' ELSE 'DOWN' END) AS direction, min(date) AS start, max(date) AS "end" FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS run FROM (SELECT symbol, date, up, CASE WHEN up IS NOT DISTINCT FROM lag(up) OVER (PARTITION BY symbol ORDER BY date) AND row_number() OVER (PARTITION BY symbol ORDER BY date) > 1 THEN 0 ELSE 1 END AS new FROM (SELECT symbol, date, close > open AS up FROM bars))) GROUP BY 1, 2)"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Every run of equal direction of every symbol."""
    return _runs(bars(spark, d).select(*KEY, (F.col("close") > F.col("open")).alias("up")))


def _runs(up: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    new = F.when(F.col("up").eqNullSafe(F.lag("up").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = up.withColumn("new", new).withColumn("id", F.sum("new").over(w).cast("long"))
    return runs.groupBy("symbol", "id").agg(F.first(F.when(F.col("up"), "UP").otherwise("DOWN")).alias("direction"), F.min("date").alias("start"), F.max("date").alias("end"))


@query("""SELECT p.symbol, p.date, coalesce(min(iv.id), 0) AS event_id FROM bars p LEFT JOIN iv ON p.symbol = iv.symbol AND p.date BETWEEN iv.start AND iv."end" + 3 GROUP BY 1, 2""", more=_IV)
def join_range_point(spark: SparkSession, d: str) -> DataFrame:
    """The first run that a bar lies in or comes at most three days after."""
    longer = _intervals(spark, d).withColumn("end", F.date_add("end", 3))
    out = rel.intervals_of(bars(spark, d).select(*KEY), longer, "date", "start", "end", ["id"], by=["symbol"])
    return out.select(*KEY, F.coalesce("id", F.lit(0)).alias("event_id"))


_SPREAD = """each AS (SELECT symbol, date, max(id) AS id, arg_max(direction, id) AS direction FROM (SELECT symbol, id, direction, CAST(unnest(range(start, "end" + 1, INTERVAL 1 DAY)) AS DATE) AS date FROM iv WHERE "end" > start) GROUP BY 1, 2)"""


@query("""SELECT symbol, date, coalesce(last_value(id IGNORE NULLS) OVER p, first_value(id IGNORE NULLS) OVER n) AS event_id, coalesce(last_value(direction IGNORE NULLS) OVER p, first_value(direction IGNORE NULLS) OVER n) AS direction FROM (SELECT b.symbol, b.date, id, direction FROM bars b LEFT JOIN each e ON b.symbol = e.symbol AND b.date = e.date)
  WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", more=f"{_IV}, {_SPREAD}")
def join_range_expand(spark: SparkSession, d: str) -> DataFrame:
    """Runs of more than a day written on each of their dates (the later wins), then filled forward and back over all bars."""
    return rel.spread_intervals(bars(spark, d).select(*KEY), _intervals(spark, d).where("end > start"), ["symbol"]).select(*KEY, F.col("id").alias("event_id"), "direction")


@query("""SELECT a.symbol, a.id AS a_id, b.id AS b_id, CAST(least(a."end", b."end") - greatest(a.start, b.start) AS BIGINT) AS shared_days,
  round((least(a."end", b."end") - greatest(a.start, b.start)) / (greatest(a."end", b."end") - least(a.start, b.start)), 6) + 0.0 AS score, CAST(floor(((a.start - b.start) + (a."end" - b."end")) / 2) AS BIGINT) AS lag_days
  FROM expected a JOIN iv b ON a.symbol = b.symbol AND a.direction = b.direction AND least(a."end", b."end") > greatest(a.start, b.start) WHERE abs(floor(((a.start - b.start) + (a."end" - b."end")) / 2)) <= 10""", uses=("bars", "forecasts"), more=f"{_IV}, {_IV.replace('iv AS', 'expected AS').replace('close > open', 'pred_05 > close').replace('FROM bars', 'FROM forecasts')}")
def join_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of days that were expected to rise or fall against the real runs of the same symbol and direction, middles 10 days apart at most."""
    expected = _runs(forecasts(spark, d).select(*KEY, (F.col("pred_05") > F.col("close")).alias("up")))
    return rounded(rel.overlaps(expected, _intervals(spark, d), ["symbol"], max_mid_days=10), "score")


@query("""SELECT symbol, n AS n_rows, round(matched, 6) + 0.0 AS matched, round(nonzero, 6) + 0.0 AS nonzero, CASE WHEN matched >= 0.95 AND nonzero >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT symbol, count(*) AS n, avg(CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END) AS matched, avg(CASE WHEN p IS NOT NULL AND p <> 0 THEN 1 ELSE 0 END) AS nonzero FROM (
    SELECT b.symbol, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date) AS n, f.pred_20 AS p FROM bars b LEFT JOIN (SELECT * FROM forecasts WHERE day(date) <= 30) f ON b.symbol = f.symbol AND b.date = f.date) WHERE n > 20 GROUP BY symbol)""", uses=("bars", "forecasts"))
def join_quality(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where(F.day("date") <= 30)
    return rounded(rel.join_quality(bars(spark, d), f, KEY, "pred_20", 20, "symbol"), "matched", "nonzero")


@query("""SELECT "column", count(x) AS n, round(avg(x), 6) + 0.0 AS mean_abs, round(max(x), 6) + 0.0 AS max_abs FROM (SELECT unnest(['open', 'high', 'close']) AS "column", unnest([abs(a.open - b.open), abs(a.high - b.high), abs(a.close - b.close)]) AS x
  FROM bars a JOIN bars b ON a.date = b.date AND a.symbol = '1-URGENT' AND b.symbol = '2-HIGH') GROUP BY 1""")
def join_compare_csv(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    out = rel.compare_columns(df.where("symbol = '1-URGENT'"), df.where("symbol = '2-HIGH'"), ["date"], ["open", "high", "close"])
    return rounded(out, "mean_abs", "max_abs")


@query("SELECT symbol, date, close FROM bars ORDER BY close DESC, symbol, date LIMIT 50")
def limit_worst_n(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select(*KEY, "close").orderBy(F.desc("close"), *KEY).limit(50)


@query("SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, date) AS n FROM bars) WHERE n = 1")
def topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("x", -F.col("close"))
    return rel.keep_first(df, ["symbol"], ["x", "date"]).select(*KEY, "close")


@query("SELECT symbol, m, n FROM (SELECT symbol, month(date) AS m, count(*) AS n, avg(close - open) AS e, max(CASE WHEN avg(close - open) < 0 AND count(*) >= 5 THEN 1 ELSE 0 END) OVER () AS any_neg FROM bars GROUP BY 1, 2) WHERE any_neg = 0 OR (e < 0 AND n >= 5)")
def topk_group(spark: SparkSession, d: str) -> DataFrame:
    g = bars(spark, d).groupBy("symbol", F.month("date").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("close") - F.col("open")).alias("e"))
    bad = (F.col("e") < 0) & (F.col("n") >= 5)
    some = g.agg(F.max(F.when(bad, 1).otherwise(0)).alias("some"))
    return g.join(F.broadcast(some)).where((F.col("some") == 0) | bad).select("symbol", "m", "n")  # one row


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1", uses=())
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep_last(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1", uses=())
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep_first(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT symbol, date, close, NULL::DOUBLE AS pred FROM bars UNION ALL SELECT symbol, date, close, pred_01 FROM forecasts", uses=("bars", "forecasts"))
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select(*KEY, "close").unionByName(forecasts(spark, d).select(*KEY, "close", F.col("pred_01").alias("pred")), allowMissingColumns=True)


@query("SELECT date FROM bars WHERE symbol = '1-URGENT' INTERSECT SELECT date FROM bars WHERE symbol = '2-HIGH'")
def intersect_dates(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    return df.where("symbol = '1-URGENT'").select("date").intersect(df.where("symbol = '2-HIGH'").select("date"))


@query("SELECT date FROM bars WHERE symbol = '1-URGENT' EXCEPT SELECT date FROM bars WHERE symbol = '2-HIGH'")
def except_dates(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    return df.where("symbol = '1-URGENT'").select("date").subtract(df.where("symbol = '2-HIGH'").select("date"))


@query("SELECT regime_id, array_to_string(['NO'] || list_filter(a, lambda x: x <> 'NO'), '|') AS agents FROM (SELECT regime_id, list_sort(list(DISTINCT agent)) AS a FROM experts JOIN regimes USING (date) GROUP BY 1)", uses=("experts", "regimes"))
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = experts(spark, d).join(regimes(spark, d), "date").groupBy("regime_id").agg(F.array_sort(F.collect_set("agent")).alias("a"))
    return a.select("regime_id", F.array_join(F.array_distinct(F.concat(F.array(F.lit("NO")), "a")), "|").alias("agents"))


_AGENTS = ("AF", "NO", "RF")


@query("SELECT date, " + ", ".join(f"max(ratio) FILTER (agent = '{a}') AS ratio_{a}" for a in _AGENTS) + " FROM experts GROUP BY date", uses=("experts",))
def pivot_agents(spark: SparkSession, d: str) -> DataFrame:
    wide = experts(spark, d).groupBy("date").pivot("agent", list(_AGENTS)).agg(F.max("ratio"))
    return wide.withColumnsRenamed({a: f"ratio_{a}" for a in _AGENTS})


@query("SELECT symbol, date, unnest(['open', 'close']) AS field, unnest([open, close]) AS value FROM bars")
def unpivot_fields(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).unpivot(KEY, ["open", "close"], "field", "value")


@query(f"SELECT symbol, date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM (SELECT *, CASE WHEN day(date) % 3 = 0 THEN close END AS x FROM bars)")
def fill_ffill_bfill(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).withColumn("x", F.when(F.day("date") % 3 == 0, F.col("close"))).select(*KEY, fill_both("x").alias("x"))


@query(f"SELECT symbol, date, greatest(least(coalesce({'(close / nullif(lag(close) OVER ' + W + ', 0) - 1)'}, 0), 0.5), -0.5) AS x FROM bars")
def fill_zero_group(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")) - 1
    return bars(spark, d).select(*KEY, F.greatest(F.least(F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)), F.lit(0.5)), F.lit(-0.5)).alias("x"))


@query(f"""SELECT symbol, date, {r('x')} FROM (SELECT symbol, date, coalesce(x, a.v + (b.v - a.v) * (i - a.i) / nullif(b.i - a.i, 0), a.v, b.v) AS x FROM (
  SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT *, CASE WHEN x IS NOT NULL THEN {{'i': i, 'v': x}} END AS k FROM (SELECT symbol, date, CASE WHEN day(date) % 4 = 0 THEN close END AS x, row_number() OVER {W} AS i FROM bars))))""")
def fill_interp(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select(*KEY, F.when(F.day("date") % 4 == 0, F.col("close")).alias("x"))
    return rounded(rel.interpolate(df, "x"), "x")
