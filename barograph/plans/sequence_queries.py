"""State along series, arrays, calendars, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions import calendar as cal
from barograph.operators import aggregates as ag
from barograph.operators import events as ev
from barograph.operators import horizons as hz
from barograph.operators import relational as rel
from barograph.operators import sequential as sq
from barograph.operators import signals as sg
from barograph.plans.aggregate_queries import _EDGES, _log
from barograph.plans.registry import W, query, r, rounded
from barograph.sources import files as fs
from barograph.sources.bars import HORIZONS, bars, experts, forecasts, regimes
from barograph.sources.tables import shared_folder, table
from barograph.streaming import live

KEY = ["symbol", "date"]
_E = "(PARTITION BY agent ORDER BY date)"


@query("SELECT agent, ratio > 0 AS up, held, CAST(greatest(5 - held, 0) AS BIGINT) AS must_hold FROM (SELECT agent, up, count(*) AS held, row_number() OVER (PARTITION BY agent ORDER BY max(date) DESC) AS n, any_value(ratio) AS ratio FROM (SELECT *, ratio > 0 AS up, row_number() OVER (PARTITION BY agent ORDER BY date) - row_number() OVER (PARTITION BY agent, ratio > 0 ORDER BY date) AS g FROM experts) GROUP BY agent, up, g) WHERE n = 1", uses=("experts",))
def seq_hold_counter(spark: SparkSession, d: str) -> DataFrame:
    return sq.hold_counter(experts(spark, d).withColumn("up", F.col("ratio") > 0), "up", 5, "agent").withColumn("must_hold", F.col("must_hold").cast("long"))


@query("SELECT symbol, date, regime_id, held FROM e", uses=("bars", "regimes"), recursive=True, more="""n AS (SELECT symbol, date, regime_id, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars JOIN regimes USING (date)),
  e AS (SELECT symbol, date, regime_id, i, regime_id AS held, 1 AS since FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.date, n.regime_id, n.i, CASE WHEN n.regime_id <> held AND since >= 3 THEN n.regime_id ELSE held END, CASE WHEN n.regime_id <> held AND since >= 3 THEN 1 ELSE since + 1 END FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)""")
def seq_min_hold_router(spark: SparkSession, d: str) -> DataFrame:
    return sq.min_hold(bars(spark, d).select(*KEY).join(regimes(spark, d), "date"), "regime_id", 3, "symbol").select(*KEY, "regime_id", "held")


_SOFT = "soft AS (SELECT date, agent, ratio, ret, exp(2 * (ir_shrink - mx)) / sum(exp(2 * (ir_shrink - mx))) OVER (PARTITION BY date) AS raw_w FROM (SELECT e.date, e.agent, e.ratio, e.ret, ir_shrink, max(ir_shrink) OVER (PARTITION BY e.date) AS mx FROM experts e JOIN regimes r ON e.date = r.date JOIN edges g ON g.regime_id = r.regime_id AND g.agent = e.agent))"


def _soft(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return sq.daily_softmax(log, ag.edge_table(log))


@query(f"SELECT date, agent, {r('raw_w')} FROM soft", uses=("experts", "regimes"), more=f"{_EDGES}, {_SOFT}")
def seq_static_softmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_soft(spark, d).select("date", "agent", "raw_w"), "raw_w")


@query(f"""SELECT date, {r('pos', 'turnover', 'cost', 'ret', 'equity')} FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM (SELECT date, pos, turnover, turnover * 10 / 10000.0 AS cost, gross - turnover * 10 / 10000.0 AS ret FROM (
  SELECT *, abs(pos - coalesce(lag(pos) OVER (ORDER BY date), 0)) AS turnover FROM (SELECT date, greatest(-1, least(1, sum(raw_w * ratio))) AS pos, sum(raw_w * ret) AS gross FROM soft GROUP BY 1))))""", uses=("experts", "regimes"), more=f"{_EDGES}, {_SOFT}")
def seq_weighted_sim(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.weighted_simulation(_soft(spark, d), "raw_w"), "pos", "turnover", "cost", "ret", "equity")


@query("""SELECT date, a[1].agent AS hard, round(a[1].s - a[2].s, 8) + 0.0 AS margin, round(CASE WHEN a[2] IS NULL OR a[1].s - a[2].s >= 0.01 THEN 1 ELSE 1 / (1 + exp(-2 * (a[1].s - a[2].s))) END, 6) + 0.0 AS w_hard FROM (SELECT date, list(struct_pack(s := ret, agent := agent) ORDER BY ret DESC, agent DESC) AS a FROM experts GROUP BY 1)""", uses=("experts",))
def seq_soft_routing(spark: SparkSession, d: str) -> DataFrame:
    scores = experts(spark, d).groupBy("date").agg(F.collect_list(F.struct(F.col("ret").alias("score"), "agent")).alias("agents"))
    out = sq.soft_routing(scores, margin=0.01)
    return rounded(rounded(out.select("date", "hard", "margin", F.element_at("weights", F.col("hard")).alias("w_hard")), "margin", digits=8), "w_hard")


@query("SELECT date, a[1] AS winner, a[2] AS runner_up FROM (SELECT date, list(agent ORDER BY ret DESC, agent DESC) AS a FROM experts GROUP BY 1)", uses=("experts",))
def win_top2(spark: SparkSession, d: str) -> DataFrame:
    best = F.reverse(F.array_sort(F.collect_list(F.struct("ret", "agent"))))
    return experts(spark, d).groupBy("date").agg(best.alias("a")).select("date", F.col("a")[0]["agent"].alias("winner"), F.get("a", F.lit(1))["agent"].alias("runner_up"))


@query("SELECT round(corr(a, b), 6) + 0.0 AS spearman, count(*) AS n FROM (SELECT agent, rank() OVER (ORDER BY round(avg(ret) FILTER (date < DATE '1996-01-01'), 9)) AS a, rank() OVER (ORDER BY round(avg(ret) FILTER (date >= DATE '1996-01-01'), 9)) AS b FROM experts GROUP BY 1 HAVING count(*) FILTER (date < DATE '1996-01-01') > 0 AND count(*) FILTER (date >= DATE '1996-01-01') > 0)", uses=("experts",))
def win_rank_consistency(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("date") < F.lit("1996-01-01").cast("date")
    m = experts(spark, d).groupBy("agent").agg(F.round(F.avg(F.when(early, F.col("ret"))), 9).alias("a"), F.round(F.avg(F.when(~early, F.col("ret"))), 9).alias("b")).where("a is not null and b is not null")
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c))  # noqa: E731  a row an agent
    return rounded(m.select(rank("a").alias("a"), rank("b").alias("b")).agg(F.corr("a", "b").alias("spearman"), F.count(F.lit(1)).alias("n")), "spearman")


@query(f"SELECT agent, date, round(ratio * coalesce(lead(ret) OVER {_E}, 0) - 0.001 * abs(ratio - coalesce(lag(ratio) OVER {_E}, 0)) - 0.01 * ratio ** 2, 6) + 0.0 AS env_reward FROM experts", uses=("experts",))
def seq_env_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.pair_environment(experts(spark, d), "ratio", "ret", "agent").select("agent", "date", "env_reward"), "env_reward")


# Actions of an asset: small, so that no step loses everything, and told by the day.
_ACT = "CASE WHEN day(date) % 3 = 0 THEN -0.002 WHEN day(date) % 3 = 1 THEN 0.0015 ELSE 0.0 END"


def _acted(spark: SparkSession, d: str) -> DataFrame:
    k = F.day("date") % 3
    return bars(spark, d).select(*KEY, "close", F.when(k == 0, -0.002).when(k == 1, 0.0015).otherwise(0.0).alias("action"))


_ENV = ["position", "daily_ret", "trade_cost", "pnl_rate", "reward", "equity", "bh_equity"]


@query(f"""SELECT symbol, date, {r(*_ENV)} FROM (SELECT *, exp(sum(ln(1 + pnl_rate)) OVER {W}) AS equity, exp(sum(ln(1 + daily_ret)) OVER {W}) AS bh_equity FROM (SELECT *, position * daily_ret - trade_cost AS pnl_rate, position * daily_ret - trade_cost - 0.01 * position ** 2 AS reward FROM (
  SELECT symbol, date, a AS position, lead(close) OVER {W} / close - 1 AS daily_ret, 0.001 * abs(a - coalesce(lag(a) OVER {W}, 0)) AS trade_cost FROM (SELECT *, {_ACT} AS a FROM bars)) WHERE daily_ret IS NOT NULL))""")
def seq_env_variants(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sg.single_environment(_acted(spark, d), "action", "close").select(*KEY, *_ENV), *_ENV)


@query(f"""SELECT symbol, date, round(position, 6) + 0.0 AS position, round(position * equity / close, 9) + 0.0 AS shares, round((1 - position) * equity, 6) + 0.0 AS cash, round(equity, 6) + 0.0 AS equity FROM (
  SELECT *, exp(sum(ln(grown * (1 - 0.001 * abs(position - drift / grown)))) OVER {W}) AS equity FROM (SELECT *, 1 + held * coalesce(close / p - 1, 0) AS grown, coalesce(held * close / p, 0) AS drift FROM (
    SELECT symbol, date, close, a AS position, coalesce(lag(a) OVER {W}, 0) AS held, lag(close) OVER {W} AS p FROM (SELECT *, {_ACT} AS a FROM bars))))""")
def seq_env_cash(spark: SparkSession, d: str) -> DataFrame:
    out = sg.cash_environment(_acted(spark, d), "action", "close")
    return rounded(rounded(out, "position", "cash", "equity"), "shares", digits=9)


@query("SELECT agent, date, round(adv, 6) + 0.0 AS advantage, round(adv + ratio, 6) + 0.0 AS target, round((adv - avg(adv) OVER w) / (stddev_pop(adv) OVER w + 0.00000001), 4) + 0.0 AS scaled FROM g WINDOW w AS (PARTITION BY agent)", uses=("experts",), recursive=True, more="""n AS (SELECT agent, date, ratio, ret + 0.99 * coalesce(lead(ratio) OVER (PARTITION BY agent ORDER BY date), 0) - ratio AS delta, row_number() OVER (PARTITION BY agent ORDER BY date DESC) AS i FROM experts),
  g AS (SELECT agent, date, ratio, i, delta AS adv FROM n WHERE i = 1 UNION ALL SELECT n.agent, n.date, n.ratio, n.i, n.delta + 0.99 * 0.95 * g.adv FROM g JOIN n ON n.agent = g.agent AND n.i = g.i + 1)""")
def seq_gae(spark: SparkSession, d: str) -> DataFrame:
    """Advantages of each agent's returns, with its ratio as the value of a day."""
    return rounded(rounded(sg.advantages(experts(spark, d), "ret", "ratio"), "advantage", "target"), "scaled", digits=4)


@query()
def arr_wavelet(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of details of each symbol's log closes."""
    df = bars(spark, d).select(*KEY, F.log("close").alias("x"))
    return rounded(sg.wavelet_details(df, "x"), "x", "x_wd1", "x_wd2", "x_wd3")


@query()
def arr_fft_lag(spark: SparkSession, d: str) -> DataFrame:
    """How far forecasts run behind the closes that they are of."""
    return rounded(sg.phase_lags(sq.anchor_to_target(forecasts(spark, d), HORIZONS).where("h = 5"), "close", "forecast", most=20.0), "lag", "slope", "intercept")


@query(f"SELECT agent, date, coalesce(lag(reward_next) OVER {_E}, 0) AS logged, CASE WHEN ratio > 0.15 THEN 'LONG' WHEN ratio < -0.15 THEN 'SHORT' ELSE 'CASH' END AS side FROM experts", uses=("experts",))
def seq_expert_log(spark: SparkSession, d: str) -> DataFrame:
    return sq.expert_log(experts(spark, d)).select("agent", "date", "logged", "side")


@query("SELECT agent, date, round(tanh(0.1 + 0.5 * ratio + 3.0 * ret), 8) + 0.0 AS action FROM experts", uses=("experts",))
def seq_linear_policy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.linear_policy(experts(spark, d), {"ratio": 0.5, "ret": 3.0}, 0.1).select("agent", "date", "action"), "action", digits=8)


@query("SELECT date, round(sum(ratio * w) / sum(w), 6) + 0.0 AS vote FROM (SELECT *, CASE WHEN agent = 'NO' THEN 2.0 ELSE 1.0 END AS w FROM experts) GROUP BY 1", uses=("experts",))
def seq_weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("agent") == "NO", 2.0).otherwise(1.0)
    return rounded(experts(spark, d).groupBy("date").agg((F.sum(F.col("ratio") * w) / F.sum(w)).alias("vote")), "vote")


@query(f"SELECT symbol, date, round(close / first_value(close) OVER {W}, 6) + 0.0 AS held FROM bars")
def seq_buy_hold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.buy_and_hold(bars(spark, d)).select(*KEY, "held"), "held")


def _turns(name: str, series: str, value: str) -> str:
    """Turning points of ``value`` in SQL: ``name`` (symbol, row, date, value, kind), chosen by folding over each symbol's extrema."""
    around = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
    beats = "((x[1].kind = 'TOP' AND x[1].value > acc[-1].value) OR (x[1].kind = 'BOTTOM' AND x[1].value < acc[-1].value))"
    return f"""{name}_c AS (
  SELECT symbol, list([struct_pack(row := row, date := date, value := value, kind := kind)] ORDER BY row, kind DESC) AS c FROM (
    SELECT symbol, row, date, value, unnest(kinds) AS kind FROM (
      SELECT symbol, date, {value} AS value, row_number() OVER (PARTITION BY symbol ORDER BY date) AS row,
             CASE WHEN count({value}) OVER {around} = 20 THEN list_filter([CASE WHEN {value} = max({value}) OVER {around} THEN 'TOP' END, CASE WHEN {value} = min({value}) OVER {around} THEN 'BOTTOM' END], lambda k: k IS NOT NULL) END AS kinds
      FROM {series} WHERE {value} IS NOT NULL)) GROUP BY symbol),
{name}_n AS (
  SELECT symbol, list_transform(list_reduce(c, lambda acc, x: CASE WHEN x[1].row - acc[-1].row >= 10 THEN acc || x WHEN x[1].kind = acc[-1].kind AND {beats} THEN acc[:-2] || x ELSE acc END), lambda p: [p]) AS c FROM {name}_c),
{name} AS (
  SELECT symbol, p.* FROM (SELECT symbol, unnest(list_reduce(c, lambda acc, x: CASE WHEN x[1].kind <> acc[-1].kind THEN acc || x WHEN {beats} THEN acc[:-2] || x ELSE acc END)) AS p FROM {name}_n))"""


def _events(name: str, points: str) -> str:
    w = "(PARTITION BY symbol ORDER BY row)"
    return f"""{name} AS (
  SELECT symbol, id, CASE WHEN kind = 'BOTTOM' THEN 'UP' ELSE 'DOWN' END AS direction, start, "end", n_bars, v1 - v0 AS move, (v1 - v0) / v0 * 100 AS move_pct, degrees(atan2(v1 - v0, n_bars)) AS angle, degrees(atan2(v1 - v0, n_bars)) / 90 AS angle_norm,
         n_bars / 20 AS length_norm, greatest(v0, v1) AS high, least(v0, v1) AS low, greatest(v0, v1) / v0 * 100 AS high_pct, least(v0, v1) / v0 * 100 AS low_pct
  FROM (SELECT symbol, kind, date AS start, value AS v0, row_number() OVER {w} - 1 AS id, lead(date) OVER {w} AS "end", lead(value) OVER {w} AS v1, lead(row) OVER {w} - row AS n_bars FROM {points}) WHERE "end" IS NOT NULL)"""


_GEOMETRY = ("move", "move_pct", "angle", "angle_norm", "length_norm", "high", "low", "high_pct", "low_pct")


@query("SELECT symbol, row, date, value, kind FROM turns", more=_turns("turns", "bars", "close"))
def seq_turning_points(spark: SparkSession, d: str) -> DataFrame:
    return ev.turning_points(bars(spark, d))


@query(f"""SELECT symbol, id, direction, start, "end", n_bars, {r(*_GEOMETRY)} FROM ev""", more=f"{_turns('turns', 'bars', 'close')}, {_events('ev', 'turns')}")
def seq_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.events(ev.turning_points(bars(spark, d))), *_GEOMETRY)


@query(f"""SELECT symbol, id, direction, start, "end", n_bars, {r(*_GEOMETRY)} FROM ev""", more=f"{_turns('turns', 'bars', 'close')}, {_events('ev', 'turns')}")
def udtf_events(spark: SparkSession, d: str) -> DataFrame:
    """The same by the table function, from SQL."""
    ev.register(spark)
    return rounded(spark.sql("SELECT * FROM series_events(TABLE({bars}), 'symbol', 'date', 'close', 20, 10)", bars=bars(spark, d).select(*KEY, "close")), *_GEOMETRY)


@query("""SELECT symbol, run, min(date) AS start, max(date) AS "end", count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS run FROM (SELECT symbol, date, CASE WHEN up IS NOT DISTINCT FROM lag(up) OVER (PARTITION BY symbol ORDER BY date) AND row_number() OVER (PARTITION BY symbol ORDER BY date) > 1 THEN 0 ELSE 1 END AS new FROM (SELECT symbol, date, close >= open AS up FROM bars))) GROUP BY 1, 2""")
def seq_direction_runs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    df = bars(spark, d).select(*KEY, (F.col("close") >= F.col("open")).alias("up"))
    new = F.when(F.col("up").eqNullSafe(F.lag("up").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n"))


def _event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events of the expected closes against those of the real ones, of the same symbol and direction."""
    expected = ev.events(ev.turning_points(forecasts(spark, d), value="pred_05"))
    return rel.overlaps(expected, ev.events(ev.turning_points(bars(spark, d))), ["symbol"], least=0.1, max_mid_days=20).withColumn("score", F.round("score", 9))


_PAIRS = f"""{_turns('turns', 'bars', 'close')}, {_events('ev', 'turns')}, {_turns('turns_x', 'forecasts', 'pred_05')}, {_events('ex', 'turns_x')},
pairs AS (SELECT symbol, a_id, b_id, shared_days, round(shared_days / either, 9) AS score, lag_days FROM (
  SELECT a.symbol, a.id AS a_id, b.id AS b_id, CAST(least(a."end", b."end") - greatest(a.start, b.start) AS BIGINT) AS shared_days, greatest(a."end", b."end") - least(a.start, b.start) AS either, CAST(floor(((a.start - b.start) + (a."end" - b."end")) / 2) AS BIGINT) AS lag_days
  FROM ex a JOIN ev b ON a.symbol = b.symbol AND a.direction = b.direction AND least(a."end", b."end") > greatest(a.start, b.start)) WHERE shared_days / either >= 0.1 AND abs(lag_days) <= 20)"""


@query("""SELECT symbol, p.a_id, p.b_id, p.shared_days, round(p.score, 6) + 0.0 AS score, p.lag_days FROM (
  SELECT symbol, unnest(list_reduce(list([struct_pack(a_id := a_id, b_id := b_id, shared_days := shared_days, score := score, lag_days := lag_days)] ORDER BY score DESC, abs(lag_days), a_id, b_id),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a_id = x[1].a_id OR y.b_id = x[1].b_id)) > 0 THEN acc ELSE acc || x END)) AS p FROM pairs GROUP BY symbol)""", uses=("bars", "forecasts"), more=_PAIRS)
def match_greedy_global(spark: SparkSession, d: str) -> DataFrame:
    """Expected events of a symbol matched with real ones from the best overlap down, each used once."""
    return rounded(sq.greedy_match(_event_pairs(spark, d), ["symbol"], "a_id", "b_id", "score", "lag_days"), "score")


@query("""SELECT symbol, a_id, best.b_id, shared_days, round(score, 6) + 0.0 AS score, lag_days, alone.b_id AS alone FROM (SELECT *, row_number() OVER (PARTITION BY symbol, a_id ORDER BY score DESC, b_id) AS n FROM pairs) best LEFT JOIN alone USING (symbol, a_id) WHERE n = 1""", uses=("bars", "forecasts"), more=_PAIRS + """,
alone AS (SELECT symbol, p.a_id, p.b_id FROM (SELECT symbol, unnest(list_reduce(list([struct_pack(a_id := a_id, b_id := b_id)] ORDER BY a_id, score DESC, b_id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a_id = x[1].a_id OR y.b_id = x[1].b_id)) > 0 THEN acc ELSE acc || x END)) AS p FROM pairs GROUP BY symbol))""")
def match_greedy_per_pred(spark: SparkSession, d: str) -> DataFrame:
    """For each expected event the best real one of its symbol, which may serve again; ``alone``: which may not."""
    pairs = _event_pairs(spark, d)
    w = Window.partitionBy("symbol", "a_id").orderBy(F.desc("score"), "b_id")
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    alone = sq.match_in_order(pairs, ["symbol"], "a_id", "b_id", "score").select("symbol", "a_id", F.col("b_id").alias("alone"))
    return rounded(best.join(alone, ["symbol", "a_id"], "left"), "score")


@query("SELECT symbol, date, CAST(len(a) AS INTEGER) AS n, a[1] AS oldest, a[5] AS newest FROM (SELECT symbol, date, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM bars) WHERE len(a) = 5")
def arr_lookback_windows(spark: SparkSession, d: str) -> DataFrame:
    out = sq.lookback(bars(spark, d), ["close", "volume"], 5)
    return out.select(*KEY, F.size("window").alias("n"), F.col("window")[0][0].alias("oldest"), F.col("window")[4][0].alias("newest"))


@query("SELECT symbol, date, close, h, f AS forecast FROM (SELECT symbol, date, close, unnest([1, 5, 10, 20]) AS h, unnest([lag(pred_01) OVER v, lag(pred_05, 5) OVER v, lag(pred_10, 10) OVER v, lag(pred_20, 20) OVER v]) AS f FROM forecasts WINDOW v AS (PARTITION BY symbol ORDER BY date)) WHERE f IS NOT NULL", uses=("bars", "forecasts"))
def arr_anchor_to_target(spark: SparkSession, d: str) -> DataFrame:
    return sq.anchor_to_target(forecasts(spark, d), HORIZONS)


@query("SELECT symbol, date, unnest([1, 2, 3, 4]) AS place, round(unnest([pred_01, pred_05 - pred_01, pred_10 - pred_05, pred_20 - pred_10]), 2) + 0.0 AS delta FROM forecasts", uses=("bars", "forecasts"))
def arr_delta_block(spark: SparkSession, d: str) -> DataFrame:
    path = F.array(*[f"pred_{h:02d}" for h in HORIZONS])
    delta = F.transform(path, lambda x, i: F.struct((i + 1).alias("place"), (x - F.coalesce(F.get(path, i - 1), F.lit(0.0))).alias("delta")))
    return rounded(forecasts(spark, d).select(*KEY, F.explode(delta).alias("e")).select(*KEY, "e.*"), "delta", digits=2)


@query("SELECT symbol, date, unnest(range(1, 26)) AS h, unnest(list_transform(range(1, 26), lambda h: CASE WHEN h < 10 THEN pred_05 WHEN h < 20 THEN pred_10 ELSE pred_20 END)) AS forecast FROM forecasts", uses=("bars", "forecasts"))
def arr_horizon_fill(spark: SparkSession, d: str) -> DataFrame:
    """Horizons 1 to 25 of forecasts for 5, 10 and 20: each from the nearest lower one, the first from the nearest upper one."""
    df = forecasts(spark, d).select(*KEY, *[F.col(f"pred_{h:02d}").alias(f"Pred_Close_t_plus_{h:02d}") for h in HORIZONS if h > 1])
    filled, _ = hz.fill_horizons(df, range(1, 26), hz.horizon_columns(df.columns))
    each = F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"h{h:02d}").alias("forecast")) for h in range(1, 26)])
    return filled.select(*KEY, F.explode(each).alias("x")).select(*KEY, "x.*")


@query("SELECT symbol, date, round(p[1], 2) + 0.0 AS a, round(p[1] + (p[2] - p[1]) * 0.5, 2) + 0.0 AS b, round(p[4], 2) + 0.0 AS c FROM (SELECT symbol, date, [pred_01, pred_05, pred_10, pred_20] AS p FROM forecasts)", uses=("bars", "forecasts"))
def arr_resample_linear(spark: SparkSession, d: str) -> DataFrame:
    df = forecasts(spark, d).withColumn("p", F.array(*[f"pred_{h:02d}" for h in HORIZONS]))
    out = sq.resample_linear(df, "p", 7)
    return rounded(out.select(*KEY, F.col("resampled")[0].alias("a"), F.col("resampled")[1].alias("b"), F.col("resampled")[6].alias("c")), "a", "b", "c", digits=2)


@query("""SELECT vec_id, label AS nearest, round(sqrt(d), 4) + 0.0 AS distance, round(1 / (1 + sqrt(d)), 4) + 0.0 AS confidence FROM (SELECT v.vec_id, c.label, sum((v.x - c.x) ** 2) AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) ** 2), c.label) AS n
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) v JOIN (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) c ON v.i = c.i GROUP BY 1, 2) WHERE n = 1""", uses=())
def arr_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("center"))
    out = sq.nearest_centroid(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), centers, "v")
    return rounded(out.select("vec_id", "nearest", "distance", "confidence"), "distance", "confidence", digits=4)


_CYCLES = [f"{fn}_k{i:02d}" for i in range(1, len(cal.PERIODS) + 1) for fn in ("sin", "cos")]


@query("SELECT date, " + ", ".join(f"round({c[:3]}(2 * pi() * (date - DATE '{cal.ANCHOR}') / {cal.PERIODS[int(c[5:]) - 1]}), 6) + 0.0 AS {c}" for c in _CYCLES) + " FROM regimes", uses=("regimes",))
def cal_cycles(spark: SparkSession, d: str) -> DataFrame:
    c = cal.cycles(F.col("date"))
    return rounded(regimes(spark, d).select("date", *[c[n].alias(n) for n in _CYCLES]), *_CYCLES)


_ANGLES = {"cal_wk_bday": "(row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY date) - 1) / 5.0"} | {n: f"(date - DATE '{cal.EPOCH}') / {p}" for n, p in cal.PHASES.items()}
_PHASES = [f"per_{n}_{fn}" for n in _ANGLES for fn in ("sin", "cos")] + [f"per_h{k}_{n}" for n in _ANGLES for k in (2, 3)]


@query("SELECT date, " + ", ".join([f"round({fn}(2 * pi() * {n}), 6) + 0.0 AS per_{n}_{fn}" for n in _ANGLES for fn in ("sin", "cos")] + [f"round(sin({k} * 2 * pi() * {n}), 6) + 0.0 AS per_h{k}_{n}" for n in _ANGLES for k in (2, 3)])
       + " FROM (SELECT date, " + ", ".join(f"{x} AS {n}" for n, x in _ANGLES.items()) + " FROM regimes)", uses=("regimes",))
def cal_phases(spark: SparkSession, d: str) -> DataFrame:
    """Calendar and moon phases of all days, with their second and third harmonics."""
    return rounded(cal.phases(regimes(spark, d).select("date")).select("date", *_PHASES), *_PHASES)


@query()
def astro_planets(spark: SparkSession, d: str) -> DataFrame:
    out = cal.planets_wide(regimes(spark, d).select("date"))
    return rounded(out, *[c for c in out.columns if c != "date"])


@query()
def astro_longitude(spark: SparkSession, d: str) -> DataFrame:
    """Geocentric longitude of each planet in degrees, its speed by the mean motion, and whether it is retrograde."""
    out = cal.geocentric(regimes(spark, d).select("date"), *cal.PLANETS)
    return rounded(out.select("date", "planet", "longitude", "speed_norm", "retrograde"), "longitude", "speed_norm")


@query()
def cal_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays without federal holidays from the first bar to the last."""
    ends = bars(spark, d).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return cal.sessions(ends, "start", "end").select("date")


@query("SELECT date, CAST(unnest([0, 1, 5]) AS INTEGER) AS n, unnest([CAST(CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date - 2 ELSE date END AS DATE), CAST(CASE isodow(date) WHEN 5 THEN date + 3 WHEN 6 THEN date + 2 WHEN 7 THEN date + 1 ELSE date + 1 END AS DATE), CAST(CASE isodow(date) WHEN 6 THEN date + 6 WHEN 7 THEN date + 5 ELSE date + 7 END AS DATE)]) AS day FROM regimes", uses=("regimes",))
def cal_weekday_step(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("n"), cal.next_weekday(F.col("date"), n).alias("day")) for n in (0, 1, 5)])
    return regimes(spark, d).select("date", F.explode(each).alias("e")).select("date", "e.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN o_orderkey % 2 = 0 THEN round(ceil(round(o_totalprice * 1.002 / 0.01, 6)) * 0.01, 2) ELSE round(floor(round(o_totalprice * 0.998 / 0.01, 6)) * 0.01, 2) END AS price, CAST(floor(1e6 * 0.5 / nullif(o_totalprice, 0)) AS BIGINT) AS shares FROM orders", uses=())
def fin_orders(spark: SparkSession, d: str) -> DataFrame:
    side, p = F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL"), F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", side.alias("side"), F.round(cal.limit_price(p, side), 2).alias("price"), cal.shares(F.lit(1e6), F.lit(-0.5), p).alias("shares"))


@query(f"SELECT symbol, date, round(close - p, 2) + 0.0 AS pnl, round(CASE WHEN abs(p) < 0.000001 THEN 0 ELSE (close - p) / p END, 8) + 0.0 AS pnl_share FROM (SELECT *, coalesce(lag(close) OVER {W}, 0) AS p FROM bars)")
def fin_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Profit of a day's equity over the day before; the first day has none before."""
    before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0))
    df = bars(spark, d).withColumn("p", before)
    out = df.select(*KEY, (F.col("close") - F.col("p")).alias("pnl"), cal.profit_share(F.col("p"), F.col("close")).alias("pnl_share"))
    return rounded(rounded(out, "pnl", digits=2), "pnl_share", digits=8)


@query("""SELECT agent, date, place, side, action, quantity FROM (SELECT agent, date, unnest([1, 2, 3, 4]) AS place, unnest(['LONG', 'SHORT', 'LONG', 'SHORT']) AS side, unnest(['SELL', 'SELL', 'BUY', 'BUY']) AS action, unnest([hl - tl, hs - ts, tl - hl, ts - hs]) AS quantity FROM (
  SELECT agent, date, tl, ts, coalesce(lag(tl) OVER v, 0) AS hl, coalesce(lag(ts) OVER v, 0) AS hs FROM (SELECT agent, date, CASE WHEN ratio >= 0.05 THEN CAST(floor(ratio * 1000) AS BIGINT) ELSE 0 END AS tl, CASE WHEN ratio <= -0.05 THEN CAST(floor(-ratio * 1000) AS BIGINT) ELSE 0 END AS ts FROM experts) WINDOW v AS (PARTITION BY agent ORDER BY date))) WHERE quantity > 0""", uses=("experts",))
def fin_order_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders that take each agent's book from its last targets to its new ones."""
    target = lambda x: F.when(x >= 0.05, F.floor(x * 1000).cast("long")).otherwise(F.lit(0).cast("long"))
    df = experts(spark, d).select("agent", "date", target(F.col("ratio")).alias("tl"), target(-F.col("ratio")).alias("ts"))
    w = Window.partitionBy("agent").orderBy("date")
    held = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0).cast("long"))
    df = df.withColumns({"hl": held("tl"), "hs": held("ts")})
    return df.select("agent", "date", F.explode(cal.order_plan(F.col("tl"), F.col("ts"), F.col("hl"), F.col("hs"))).alias("o")).select("agent", "date", "o.*")


_WORDS = ["Up ", "SELL", "+1", "minus1", "上昇", "下降", "flat", "TRUE"]


@query("SELECT event_id, CASE WHEN t IN ('up', '+1', 'true') OR contains(t, '上') THEN 'UP' WHEN t IN ('sell', 'minus1') OR contains(t, '下') THEN 'DOWN' END AS direction FROM (SELECT event_id, lower(trim((['Up ', 'SELL', '+1', 'minus1', '上昇', '下降', 'flat', 'TRUE'])[event_id % 8 + 1])) AS t FROM events)", uses=())
def str_direction(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, _WORDS))
    return table(spark, d, "events").select("event_id", cal.direction(F.get(words, (F.col("event_id") % 8).cast("int"))).alias("direction"))


@query("SELECT regime_id, unnest(string_split('NO|' || a, '|')) AS agent FROM (SELECT regime_id, string_agg(DISTINCT agent, '|' ORDER BY agent) AS a FROM experts JOIN regimes USING (date) WHERE agent <> 'NO' GROUP BY 1)", uses=("experts", "regimes"))
def arr_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """A list written as text, read back a row an agent."""
    own = experts(spark, d).join(regimes(spark, d), "date").where("agent <> 'NO'").groupBy("regime_id").agg(F.array_join(F.array_sort(F.collect_set("agent")), "|").alias("a"))
    return own.select("regime_id", F.explode(F.split(F.concat(F.lit("NO|"), "a"), r"\|")).alias("agent"))


@query("SELECT date, CASE WHEN AF >= NO_ AND AF >= RF THEN 'AF' WHEN NO_ >= RF THEN 'NO' ELSE 'RF' END AS best FROM (SELECT date, coalesce(max(ratio) FILTER (agent = 'AF'), -9) AS AF, coalesce(max(ratio) FILTER (agent = 'NO'), -9) AS NO_, coalesce(max(ratio) FILTER (agent = 'RF'), -9) AS RF FROM experts GROUP BY 1)", uses=("experts",))
def arr_row_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The column of a row's greatest value; the first of equals."""
    wide = experts(spark, d).groupBy("date").pivot("agent", ["AF", "NO", "RF"]).agg(F.max("ratio"))
    each = F.array(*[F.struct(F.coalesce(c, F.lit(-9.0)).alias("x"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(("AF", "NO", "RF"))])
    return wide.select("date", F.array_max(each)["name"].alias("best"))


@query("SELECT DISTINCT date, CAST(date - INTERVAL 6 MONTH AS DATE) AS half_year_ago, CAST(date - INTERVAL 8 YEAR AS DATE) AS years_ago, strftime(date, '%Y-%m') AS month, strftime(date, '%Y%m%d') AS stamp FROM bars")
def date_offsets(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("date")
    return bars(spark, d).select("date").distinct().select("date", F.add_months(x, -6).alias("half_year_ago"), F.add_months(x, -96).alias("years_ago"), F.date_format(x, "yyyy-MM").alias("month"), F.date_format(x, "yyyyMMdd").alias("stamp"))


@query(f"SELECT symbol, date, {r('a', 'b', 'c', 'd')} FROM (SELECT symbol, date, sqrt(abs(x)) AS a, exp(greatest(-20, least(20, x))) AS b, degrees(atan2(x, 1.0)) AS c, sqrt(x * x + 1) AS d FROM (SELECT symbol, date, (close - open) / 100000 AS x FROM bars))")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("x", (F.col("close") - F.col("open")) / 100000)
    out = df.select(*KEY, F.sqrt(F.abs("x")).alias("a"), F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("x")))).alias("b"), F.degrees(F.atan2(F.col("x"), F.lit(1.0))).alias("c"), F.hypot(F.col("x"), F.lit(1.0)).alias("d"))
    return rounded(out, "a", "b", "c", "d")


@query("""SELECT o_custkey, o_orderkey, array_to_string(list_transform(list_sort(list(date))[-3:], lambda x: CAST(x AS VARCHAR)), '|') AS last_days FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) o JOIN (SELECT DISTINCT date FROM bars) b ON b.date <= o.day AND b.date > o.day - 40 GROUP BY 1, 2""")
def win_lookback(spark: SparkSession, d: str) -> DataFrame:
    """For each given date the last three trading days up to it."""
    days = bars(spark, d).select("date").distinct()
    back = sq.last_rows(days, 3)
    asked = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date")).withColumn("of", F.lit(0))
    found = rel.asof(asked, back.withColumn("of", F.lit(0)), "date", ["of"], ["last_days"])
    return found.select("o_custkey", "o_orderkey", F.array_join(F.transform("last_days", lambda x: x.cast("string")), "|").alias("last_days"))


@query("SELECT symbol, date, upper(substr(sha256(symbol || '|' || CAST(date AS VARCHAR)), 1, 16)) AS signature FROM bars")
def str_signature(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("|", "symbol", F.col("date").cast("string"))
    return bars(spark, d).select(*KEY, F.upper(F.left(F.sha2(text, 256), F.lit(16))).alias("signature"))


@query("SELECT event_id, try_cast(replace(k, ',', '') AS DOUBLE) AS x FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) ELSE 'n/a' END AS k FROM events)", uses=())
def conv_number(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    k = F.when(i % 3 == 0, F.concat(F.lit("1,"), F.lpad((i % 1000).cast("string"), 3, "0"))).when(i % 3 == 1, i.cast("string")).otherwise("n/a")
    return table(spark, d, "events").select("event_id", cal.number(k).alias("x"))


@query("SELECT date, regime_id, CAST(json_extract(w, '$.NO') AS DOUBLE) AS w_no FROM (SELECT date, regime_id, json_object('NO', 0.5, 'AF', 0.5) AS w FROM regimes)", uses=("regimes",))
def json_weights(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.create_map(F.lit("NO"), F.lit(0.5), F.lit("AF"), F.lit(0.5)))
    back = regimes(spark, d).select("date", "regime_id", F.from_json(text, "map<string, double>").alias("w"))
    return back.select("date", "regime_id", F.col("w")["NO"].alias("w_no"))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT symbol, date, open, high, low, close, volume FROM bars")
def scan_prices_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fs.write_csv(bars(spark, d), _place(spark, "prices"))
    found = fs.first_existing(spark, [f"{path}-elsewhere", path])
    return fs.scan_csv(spark, found, fs.BAR_SCHEMA)


@query("SELECT symbol, date, close FROM bars")
def scan_split_pair(spark: SparkSession, d: str) -> DataFrame:
    """Train and test files that share days: the test row of a day wins."""
    cols, schema = bars(spark, d).select(*KEY, "close"), "symbol string, date date, close double"
    a = fs.write_csv(cols.where(F.year("date") <= 1996), _place(spark, "train"))
    b = fs.write_csv(cols.where(F.year("date") >= 1996), _place(spark, "test"))
    both = fs.scan_csv(spark, a, schema).withColumn("of", F.lit(0)).unionByName(fs.scan_csv(spark, b, schema).withColumn("of", F.lit(1)))
    return rel.keep_last(both, KEY, ["of"]).drop("of")


@query("SELECT agent, date, ratio FROM experts", uses=("experts",))
def scan_glob(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each agent; the agent is read from the path."""
    path = fs.write_csv(experts(spark, d).select("agent", "date", "ratio"), _place(spark, "logs"), by=["agent"])
    rows = spark.read.schema("date date, ratio double").option("header", True).csv(f"{path}/agent=*")
    return rows.select(fs.name_in_path(r"agent=([^/]+)/").alias("agent"), "date", "ratio")


@query("SELECT symbol, strftime(date, '%Y') AS year, count(*) AS n FROM bars GROUP BY 1, 2")
def scan_daily_files(spark: SparkSession, d: str) -> DataFrame:
    path = fs.write_csv(bars(spark, d).withColumn("year", F.date_format("date", "yyyy")).select("symbol", "close", "year"), _place(spark, "daily"), by=["year"])
    rows = spark.read.schema("symbol string, close double").option("header", True).csv(f"{path}/year=*")
    return rows.select("symbol", fs.name_in_path(r"year=(\d{4})/").alias("year")).groupBy("symbol", "year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, date, close FROM bars")
def scan_all_recursive(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "tree")
    df = bars(spark, d).select(*KEY, "close")
    fs.write_csv(df.where("symbol <= '3'"), f"{path}/a/b")
    fs.write_csv(df.where("symbol > '3'"), f"{path}/c")
    return fs.scan_recursive(spark, path, "symbol string, date date, close double").drop("file")


@query("SELECT CAST(min(date) AS VARCHAR) AS train_start, CAST(max(date) AS VARCHAR) AS test_end FROM bars")
def scan_kv(spark: SparkSession, d: str) -> DataFrame:
    ends = bars(spark, d).agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"))
    kv = ends.select(F.explode(F.create_map(F.lit("train_start"), F.col("a"), F.lit("test_end"), F.col("b"))).alias("key", "value"))
    path = fs.write_csv(kv, _place(spark, "summary"))
    return fs.scan_kv(fs.scan_csv(spark, path, "key string, value string"), ["train_start", "test_end"])


@query("SELECT CAST(min(date) AS VARCHAR) AS test_start, count(DISTINCT date) AS n_days, 1 AS n_bad FROM bars")
def scan_json(spark: SparkSession, d: str) -> DataFrame:
    """A summary written as one document, read beside one that is damaged."""
    place = _place(spark, "summaries")
    text = bars(spark, d).agg(F.min("date").cast("string").alias("test_start"), F.count_distinct("date").alias("n_days")).select(F.to_json(F.struct("*")).alias("t")).first()["t"]  # one row
    fs.write_json_atomic(spark, "{}", f"{place}/good.json")
    fs.write_json_atomic(spark, text, f"{place}/good.json")
    fs.write_json_atomic(spark, '{"test_start": ', f"{place}/bad.json")
    rows = fs.scan_json(spark, place, "test_start string, n_days bigint")
    return rows.agg(F.max("test_start").alias("test_start"), F.max("n_days").alias("n_days"), F.sum(F.col("n_days").isNull().cast("int")).cast("int").alias("n_bad"))


@query("SELECT symbol, date, CASE WHEN day(date) % 4 > 0 THEN close ELSE open END AS x FROM bars")
def scan_priority(spark: SparkSession, d: str) -> DataFrame:
    """A file that is missing, one with gaps, and a fallback."""
    df, place = bars(spark, d), _place(spark, "priority")
    fs.write_csv(df.select(*KEY, F.when(F.day("date") % 4 > 0, F.col("close")).alias("x")), f"{place}/path")
    fs.write_csv(df.select(*KEY, F.col("open").alias("x")), f"{place}/fallback")
    return fs.scan_by_priority(spark, [f"{place}/sequence", f"{place}/path", f"{place}/fallback"], "symbol string, date date, x double", KEY)


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1", uses=())
def sink_jsonl_append(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "timings")
    for _ in range(2):
        table(spark, d, "events").select("event_type", "value").write.mode("append").json(path)
    return spark.read.schema("event_type string, value double").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(max(value), 6) + 0.0 AS high FROM events GROUP BY 1", uses=())
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "events")
    table(spark, d, "events").select("event_type", "value").write.json(path)
    rows = spark.read.schema("event_type string, value double").json(path)
    return rounded(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high")), "high")


@query("SELECT symbol, date, close FROM bars WHERE day(date) > 3")
def date_col_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.day("date") <= 3, "soon").when(F.day("date") % 2 == 0, F.date_format("date", "yyyy/M/d")).otherwise(F.col("date").cast("string"))
    return fs.normalize_date(bars(spark, d).select("symbol", text.alias("DATE"), "close")).select(*KEY, "close")


@query("SELECT symbol, date, close FROM bars WHERE day(date) <> 31 UNION ALL SELECT symbol, date, open FROM bars WHERE day(date) = 31")
def sink_append_csv(spark: SparkSession, d: str) -> DataFrame:
    df, path = bars(spark, d), _place(spark, "log")
    fs.write_csv(df.where(F.day("date") != 31).select(*KEY, "close"), path)
    fs.write_csv(df.where(F.day("date") == 31).select(*KEY, F.col("open").alias("close")), path, mode="append")
    return fs.scan_csv(spark, path, "symbol string, date date, close double")


@query("SELECT symbol, date, CASE WHEN day(date) > 20 THEN open ELSE close END AS close FROM bars WHERE day(date) > 5")
def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d)
    base = df.where((F.day("date") > 5) & (F.day("date") <= 25)).select(*KEY, "close")
    return rel.upsert(base, df.where(F.day("date") > 20).select(*KEY, F.col("open").alias("close")), KEY)


@query("SELECT symbol, date, close FROM bars")
def sink_csv_ignore(spark: SparkSession, d: str) -> DataFrame:
    """A second write to the same place changes nothing."""
    path = fs.write_csv(bars(spark, d).select(*KEY, "close"), _place(spark, "once"))
    fs.write_csv(bars(spark, d).select(*KEY, F.lit(0.0).alias("close")), path, mode="ignore")
    return fs.scan_csv(spark, path, "symbol string, date date, close double")


@query("SELECT symbol, date, close, CAST(1 AS INTEGER) AS n_dropped FROM bars")
def sanitize_cols(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).withColumn("label_next", F.col("close"))
    bad = fs.suspicious(df.columns)
    return df.drop(*bad).select(*KEY, "close", F.lit(len(bad)).alias("n_dropped"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2", uses=())
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every window, also those that the watermark has not closed: the last update of each is kept."""
    late = live.spread(spark, d, "events.parquet", "ts")
    updates = live.run_updates(live.windowed_counts(live.replay(spark, d, "events.parquet"), late=late))
    return rounded(live.last_updates(updates, ["start", "event_type"]), "total", digits=4)


@query("SELECT event_id, user_id, event_type FROM events", uses=())
def stream_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Each event delivered twice, taken once."""
    late = live.spread(spark, d, "events.parquet", "ts")
    twice = live.replay(spark, d, "events.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return live.run_to_table(live.first_of_each(twice, ["event_id"], late).select("event_id", "user_id", "event_type"))


@query("SELECT symbol, date, close FROM (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)", uses=())
def stream_bar_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a stream of ticks; a bar's close is its last tick's so far, and each update replaces the one before."""
    ticks = live.replay(spark, d, "orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    updates = live.run_updates(live.last_ticks(ticks, ["symbol", "date"], "o_orderkey", "o_totalprice"))
    return live.last_updates(updates, ["symbol", "date"]).select("symbol", "date", F.col("value").alias("close"))
