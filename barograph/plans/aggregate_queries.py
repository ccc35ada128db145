"""Aggregates, regime and agent statistics, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.windows import change, ratio
from barograph.operators import aggregates as ag
from barograph.operators import audits as au
from barograph.operators import features as ft
from barograph.operators import reports as rp
from barograph.operators import sequential as sq
from barograph.operators import timings as tm
from barograph.plans.registry import W, over, query, r, rounded
from barograph.sources.bars import HORIZONS, bars, experts, forecasts, regimes
from barograph.sources.tables import table

_RETS = f"rets AS (SELECT symbol, date, coalesce(close / nullif(lag(close) OVER {W}, 0) - 1, 0) / 1000 AS ret FROM bars)"


def _rets(spark: SparkSession, d: str) -> DataFrame:
    """Changes of closes, scaled so that no day loses everything."""
    return bars(spark, d).select("symbol", "date", (F.coalesce(change("close"), F.lit(0.0)) / 1000).alias("ret"))


_DD = "dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date) - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date)) AS equity FROM rets))"


@query(f"""SELECT symbol, n, {r('mean', 'sd', 'win_rate', 'max_dd', 'multiple', 'sharpe')} FROM (SELECT symbol, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate,
  min(drawdown) AS max_dd, arg_max(equity, date) AS multiple, coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) AS sharpe FROM dd GROUP BY symbol)""", more=f"{_RETS}, {_DD}")
def agg_ret_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.return_metrics(_rets(spark, d), ["symbol"]), "mean", "sd", "win_rate", "max_dd", "multiple", "sharpe")


@query(f"SELECT symbol, date, {r('equity', 'drawdown')} FROM dd", more=f"{_RETS}, {_DD}")
def seq_equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.with_drawdown(_rets(spark, d), ["symbol"]).select("symbol", "date", "equity", "drawdown"), "equity", "drawdown")


@query(f"""SELECT symbol, {r('total_pct', 'max_dd', 'sharpe', 'volatility', 'win_rate')} FROM (SELECT symbol, 100 * (arg_max(close, date) / arg_min(close, date) - 1) AS total_pct, min(dd) AS max_dd, coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 0) AS sharpe,
  stddev_samp(x) * sqrt(252) AS volatility, avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) AS win_rate
  FROM (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS x, close / max(close) OVER {W} - 1 AS dd FROM bars) GROUP BY symbol)""")
def agg_split_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.split_metrics(bars(spark, d), ["symbol"]), "total_pct", "max_dd", "sharpe", "volatility", "win_rate")


_EDGES = """edges AS (SELECT c.*, n_days / (n_days + 20.0) AS w_shrink, n_days / (n_days + 20.0) * ev + (1 - n_days / (n_days + 20.0)) * ev_global AS ev_shrink, n_days / (n_days + 20.0) * ir + (1 - n_days / (n_days + 20.0)) * ir_global AS ir_shrink, ev_global, ir_global FROM (
  SELECT regime_id, agent, count(*) AS n_days, avg(ret) AS ev, coalesce(avg(ret) / nullif(stddev_pop(ret), 0), 0) AS ir, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS p_win, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95
  FROM experts JOIN regimes USING (date) GROUP BY 1, 2) c JOIN (SELECT agent, avg(ret) AS ev_global, coalesce(avg(ret) / nullif(stddev_pop(ret), 0), 0) AS ir_global FROM experts JOIN regimes USING (date) GROUP BY 1) g ON c.agent = g.agent)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return experts(spark, d).join(regimes(spark, d), "date")


_EDGE_COLUMNS = ["ev", "ir", "p_win", "q05", "q95", "w_shrink", "ev_shrink", "ir_shrink", "ev_global", "ir_global"]


# Means of days with few digits are often exactly half way between two roundings, where engines round apart: a thousandth of
# the last digit, added on both sides, decides.
_MEANS = ("ev", "ev_shrink", "ev_global")
_OTHERS = [c for c in _EDGE_COLUMNS if c not in _MEANS]
_HALF = 1e-15


@query(f"SELECT regime_id, agent, n_days, {r(*_OTHERS)}, {', '.join(f'round({c} + {_HALF}, 12) + 0.0 AS {c}' for c in _MEANS)} FROM edges", uses=("experts", "regimes"), more=_EDGES)
def agg_edge_table(spark: SparkSession, d: str) -> DataFrame:
    edges = ag.edge_table(_log(spark, d)).select("regime_id", "agent", "n_days", *_EDGE_COLUMNS)
    edges = edges.withColumns({c: F.col(c) + _HALF for c in _MEANS})
    return rounded(rounded(edges, *_OTHERS), *_MEANS, digits=12)


@query("SELECT regime_id, agent, CAST(row_number() OVER (PARTITION BY regime_id ORDER BY round(ir, 9) DESC, round(ev, 9) DESC, agent) AS INTEGER) AS rank FROM edges", uses=("experts", "regimes"), more=_EDGES)
def win_rank_table(spark: SparkSession, d: str) -> DataFrame:
    return ranks_of(ag.edge_table(_log(spark, d)))


def ranks_of(edges: DataFrame) -> DataFrame:
    w = Window.partitionBy("regime_id").orderBy(F.desc(F.round("ir", 9)), F.desc(F.round("ev", 9)), "agent")
    return edges.select("regime_id", "agent", F.row_number().over(w).alias("rank"))


@query("""SELECT regime_id, round(median(x), 6) + 0.0 AS median_x, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) + 0.0 AS iqr_x, round(stddev_pop(x), 6) + 0.0 AS sd_x, round(median(v), 6) + 0.0 AS median_v, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) + 0.0 AS iqr_v, round(stddev_pop(v), 6) + 0.0 AS sd_v
  FROM (SELECT date, close - open AS x, volume AS v FROM bars) JOIN regimes USING (date) GROUP BY 1""", uses=("bars", "regimes"))
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    df = bars(spark, d).select("date", (F.col("close") - F.col("open")).alias("x"), F.col("volume").alias("v")).join(regimes(spark, d), "date")
    return rounded(ag.profile(df, "regime_id", ["x", "v"]), "median_x", "iqr_x", "sd_x", "median_v", "iqr_v", "sd_v")


@query("SELECT agent, round(m, 6) + 0.0 AS m, round(CASE WHEN stddev_pop(m) OVER () <= 1e-12 THEN 0 ELSE (m - avg(m) OVER ()) / stddev_pop(m) OVER () END, 4) + 0.0 AS z_m FROM (SELECT agent, avg(ratio) AS m FROM experts GROUP BY 1)", uses=("experts",))
def agg_zscore_groups(spark: SparkSession, d: str) -> DataFrame:
    out = ag.zscore_groups(experts(spark, d).groupBy("agent").agg(F.avg("ratio").alias("m")), "m")
    return rounded(rounded(out, "m"), "z_m", digits=4)


_LABEL_Z = lambda x: f"coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0)"
_PROFILES = f"""ft AS (SELECT symbol, date, close / nullif(lag(close, 5) OVER {W}, 0) - 1 AS ret_5, close / nullif(lag(close, 20) OVER {W}, 0) - 1 AS ret_20, close / nullif(lag(close, 60) OVER {W}, 0) - 1 AS ret_60,
    close / nullif({over('avg', 'close', 20, 5)}, 0) - 1 AS ma_dev, {over('stddev_pop', 'r1', 20, 5)} * sqrt(252) AS vol20, close / nullif({over('max', 'close', 20, 1)}, 0) - 1 AS dd20, CASE WHEN r1 < -0.05 THEN 1.0 ELSE 0.0 END AS panic,
    (volume - {over('avg', 'volume', 20, 5)}) / nullif({over('stddev_pop', 'volume', 20, 5)}, 0) AS volume_z FROM (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS r1 FROM bars)),
  pf AS (SELECT symbol || '-' || regime_id AS name, {", ".join(f"{'avg' if c == 'panic' else 'median'}({c}) AS {c}" for c in ag.PROFILE)} FROM ft JOIN regimes USING (date) GROUP BY 1),
  sc AS (SELECT *, round({_LABEL_Z('ret_20')} + {_LABEL_Z('ret_60')} + {_LABEL_Z('ma_dev')} - {_LABEL_Z('dd20')} - 0.5 * {_LABEL_Z('vol20')}, 9) AS trend, round({_LABEL_Z('vol20')} + 0.5 * {_LABEL_Z('volume_z')}, 9) AS vol, round(-{_LABEL_Z('dd20')}, 9) AS drawdown, round({_LABEL_Z('panic')} + 0.5 * {_LABEL_Z('volume_z')}, 9) AS panic_score FROM pf)"""


@query(f"""SELECT name, {r('trend', 'vol', 'drawdown', 'panic_score', digits=5)}, round(sqrt(trend * trend + vol * vol + drawdown * drawdown + panic_score * panic_score), 5) + 0.0 AS separability,
  CASE WHEN panic_score > 1 AND vol > 0.75 THEN '{ag.PANIC}' WHEN trend > 1 AND vol < 0.5 THEN '{ag.RISING}' WHEN trend < -1 AND vol >= 0 THEN '{ag.FALLING}' WHEN vol > 1 AND ret_20 < 0 THEN '{ag.WILD_FALL}' WHEN vol < -0.5 AND abs(trend) < 0.75 THEN '{ag.QUIET}' WHEN dd20 < -0.08 AND ret_5 > 0 AND trend > 0 THEN '{ag.REBOUND}' ELSE '{ag.UNCLEAR}' END AS label FROM sc""", uses=("bars", "regimes"), more=_PROFILES)
def agg_scores_label(spark: SparkSession, d: str) -> DataFrame:
    """Scores and labels of each symbol's regimes, from medians of their features."""
    w = Window.partitionBy("symbol").orderBy("date")
    back = lambda n: ratio(F.col("close"), F.lag("close", n).over(w)) - 1
    df = ft.evaluation(bars(spark, d)).withColumns({"ret_5": back(5), "ret_20": back(20), "ret_60": back(60), "panic": (F.coalesce(back(1), F.lit(0.0)) < -0.05).cast("double")})
    name = F.concat_ws("-", "symbol", F.col("regime_id").cast("string"))
    profile = df.join(regimes(spark, d), "date").groupBy(name.alias("name")).agg(*[(F.avg(c) if c == "panic" else F.percentile(c, 0.5)).alias(c) for c in ag.PROFILE])
    return rounded(ag.profile_labels(profile).select("name", "trend", "vol", "drawdown", "panic_score", "separability", "label"), "trend", "vol", "drawdown", "panic_score", "separability", digits=5)


@query("""SELECT agent, CAST(count(*) AS BIGINT) AS n, round(arg_max(eq, date) - 1, 6) + 0.0 AS total, round(avg(ret), 6) + 0.0 AS mean, round(coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0), 6) + 0.0 AS sharpe, round(min(eq / peak - 1), 6) + 0.0 AS max_dd, round(avg(t), 6) + 0.0 AS turnover FROM (
  SELECT *, max(eq) OVER (PARTITION BY agent ORDER BY date) AS peak FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY agent ORDER BY date)) AS eq, abs(ratio - coalesce(lag(ratio) OVER (PARTITION BY agent ORDER BY date), 0)) AS t FROM experts)) GROUP BY 1""", uses=("experts",))
def agg_summary_returns(spark: SparkSession, d: str) -> DataFrame:
    """Total return, Sharpe ratio, worst drawdown and mean change of the position (the first from 0)."""
    w = Window.partitionBy("agent").orderBy("date")
    log = experts(spark, d)
    moves = log.withColumn("t", F.abs(F.col("ratio") - F.coalesce(F.lag("ratio").over(w), F.lit(0.0)))).groupBy("agent").agg(F.avg("t").alias("turnover"))
    m = ag.return_metrics(log, ["agent"]).join(moves, "agent").withColumn("total", F.col("multiple") - 1)
    return rounded(m.select("agent", "n", "total", "mean", "sharpe", "max_dd", "turnover"), "total", "mean", "sharpe", "max_dd", "turnover")


@query("""SELECT date, agent, round(greatest(best - ret, 0), 6) + 0.0 AS regret, round(ret - 0.4321 * greatest(best - ret, 0), 6) + 0.0 AS adjusted, round(ret - 0.12345678 * (1 - eq / peak), 6) + 0.0 AS light_risk FROM (
  SELECT *, max(eq) OVER (PARTITION BY agent ORDER BY date) AS peak FROM (SELECT *, max(ret) OVER (PARTITION BY date) AS best, exp(sum(ln(1 + ret)) OVER (PARTITION BY agent ORDER BY date)) AS eq FROM experts))""", uses=("experts",))
def agg_reward_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Returns less a share of the regret, and less a share of the drawdown so far."""
    regret = F.greatest(F.max("ret").over(Window.partitionBy("date")) - F.col("ret"), F.lit(0.0))
    out = ag.with_drawdown(experts(spark, d), ["agent"]).withColumn("regret", regret)
    return rounded(out.select("date", "agent", "regret", (F.col("ret") - 0.4321 * F.col("regret")).alias("adjusted"), (F.col("ret") + 0.12345678 * F.col("drawdown")).alias("light_risk")), "regret", "adjusted", "light_risk")


_BY_REGIME = """ed AS (SELECT *, eq / max(eq) OVER (PARTITION BY regime_id, agent ORDER BY date) - 1 AS dd FROM (SELECT e.*, regime_id, exp(sum(ln(1 + ret)) OVER (PARTITION BY regime_id, agent ORDER BY date)) AS eq FROM experts e JOIN regimes USING (date))),
  em AS (SELECT regime_id, agent, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(dd) AS max_dd, avg(ratio) AS mean_ratio FROM ed GROUP BY 1, 2)"""



@query("""SELECT regime_id, agent, n, round(mean, 8) + 0.0 AS mean, round(coalesce(mean / nullif(sd, 0) * sqrt(252), 0), 6) + 0.0 AS sharpe, round(win_rate, 6) + 0.0 AS win_rate, round(max_dd, 6) + 0.0 AS max_dd, round(mean_ratio, 6) + 0.0 AS mean_ratio,
  round(max(mean) OVER (PARTITION BY regime_id) - min(mean) OVER (PARTITION BY regime_id), 8) + 0.0 AS spread, count(*) OVER (PARTITION BY regime_id) AS n_agents FROM em""", uses=("experts", "regimes"), more=_BY_REGIME)
def agg_cluster_effect(spark: SparkSession, d: str) -> DataFrame:
    """What each agent earns in each regime, and how far the agents lie apart there."""
    log = _log(spark, d)
    m = ag.return_metrics(log, ["regime_id", "agent"]).join(log.groupBy("regime_id", "agent").agg(F.avg("ratio").alias("mean_ratio")), ["regime_id", "agent"])
    w = Window.partitionBy("regime_id")
    m = m.withColumns({"spread": F.max("mean").over(w) - F.min("mean").over(w), "n_agents": F.count(F.lit(1)).over(w)})
    out = m.select("regime_id", "agent", "n", "mean", "sharpe", "win_rate", "max_dd", "mean_ratio", "spread", "n_agents")
    return rounded(rounded(out, "mean", "spread", digits=8), "sharpe", "win_rate", "max_dd", "mean_ratio")


_TOP = "tops AS (SELECT date, regime_id, arg_max(agent, struct_pack(a := ret, b := agent)) AS best, max(ret) AS best_ret FROM experts JOIN regimes USING (date) GROUP BY 1, 2)"


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("date", "regime_id").agg(F.max_by("agent", F.struct("ret", "agent")).alias("best"), F.max("ret").alias("best_ret"))


_Z = "coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0)"


@query(f"""SELECT regime_id, n, {r('mean', digits=8)}, {r('sharpe', 'max_dd', 'ratio_mean', 'ratio_sd', 'turnover_mean', 'share')}, top1, best_agent, {r('best_mean', 'delta', digits=8)},
  round({_Z.format(x='sharpe')} - 0.5 * {_Z.format(x='(-max_dd)')} - 0.25 * {_Z.format(x='turnover_mean')} + 0.5 * {_Z.format(x='delta')}, 5) + 0.0 AS utility FROM (
  SELECT m.*, coalesce(mean / nullif(sd, 0) * sqrt(252), 0) AS sharpe, top1, top_n / n AS share, best_agent, best_mean, mean - best_mean AS delta FROM (
    SELECT regime_id, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd, min(dd) AS max_dd, avg(ratio) AS ratio_mean, stddev_pop(ratio) AS ratio_sd, avg(turnover) AS turnover_mean FROM (
      SELECT *, eq / max(eq) OVER (PARTITION BY regime_id ORDER BY date) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY regime_id ORDER BY date)) AS eq FROM picks)) GROUP BY 1) m
  JOIN (SELECT regime_id, arg_max(agent, struct_pack(a := c, b := agent)) AS top1, max(c) AS top_n FROM (SELECT regime_id, agent, count(*) AS c FROM picks GROUP BY 1, 2) GROUP BY 1) USING (regime_id)
  JOIN (SELECT regime_id, arg_max(agent, struct_pack(a := round(mean, 9), b := agent)) AS best_agent, max(mean) AS best_mean FROM em GROUP BY 1) USING (regime_id))""", uses=("experts", "regimes"), more=f"""{_BY_REGIME},
  picks AS (SELECT *, abs(ratio - coalesce(lag(ratio) OVER (ORDER BY date), 0)) AS turnover FROM (SELECT date, regime_id, arg_max(agent, struct_pack(a := ratio, b := agent)) AS agent, arg_max(ratio, struct_pack(a := ratio, b := agent)) AS ratio, arg_max(ret, struct_pack(a := ratio, b := agent)) AS ret FROM experts JOIN regimes USING (date) GROUP BY 1, 2))""")
def agg_router_effect(spark: SparkSession, d: str) -> DataFrame:
    """A router that takes the agent of the highest ratio: what it earns in each regime, against the best agent there, and a utility from z-scores."""
    log = _log(spark, d)
    best = lambda c: F.max_by(c, F.struct("ratio", "agent")).alias(c)
    picks = log.groupBy("date", "regime_id").agg(best("agent"), best("ratio"), best("ret"))
    one = Window.partitionBy(F.lit(0))  # a book has a row a day, and the regimes are few
    picks = picks.withColumn("turnover", F.abs(F.col("ratio") - F.coalesce(F.lag("ratio").over(one.orderBy("date")), F.lit(0.0))))
    m = ag.return_metrics(picks, ["regime_id"]).join(picks.groupBy("regime_id").agg(F.avg("ratio").alias("ratio_mean"), F.stddev_pop("ratio").alias("ratio_sd"), F.avg("turnover").alias("turnover_mean")), "regime_id")
    top = picks.groupBy("regime_id", "agent").agg(F.count(F.lit(1)).alias("c")).groupBy("regime_id").agg(F.max_by("agent", F.struct("c", "agent")).alias("top1"), F.max("c").alias("top_n"))
    own = log.groupBy("regime_id", "agent").agg(F.avg("ret").alias("m")).groupBy("regime_id").agg(F.max_by("agent", F.struct(F.round("m", 9), "agent")).alias("best_agent"), F.max("m").alias("best_mean"))
    m = m.join(top, "regime_id").join(own, "regime_id").withColumns({"share": F.col("top_n") / F.col("n"), "delta": F.col("mean") - F.col("best_mean"), "loss": -F.col("max_dd")})
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(one)) / F.nullif(F.stddev_pop(c).over(one), F.lit(0.0)), F.lit(0.0))
    m = m.withColumn("utility", z("sharpe") - 0.5 * z("loss") - 0.25 * z("turnover_mean") + 0.5 * z("delta"))
    out = m.select("regime_id", "n", "mean", "sharpe", "max_dd", "ratio_mean", "ratio_sd", "turnover_mean", "share", "top1", "best_agent", "best_mean", "delta", "utility")
    return rounded(rounded(rounded(out, "mean", "best_mean", "delta", digits=8), "sharpe", "max_dd", "ratio_mean", "ratio_sd", "turnover_mean", "share"), "utility", digits=5)


@query("SELECT segment, count(*) AS n, round(avg(close), 4) + 0.0 AS mean_close FROM (SELECT close, unnest(list_filter([CASE WHEN regime_id = 0 THEN 'rare' ELSE 'common' END, CASE WHEN volume > 1 THEN 'busy' END], lambda x: x IS NOT NULL)) AS segment FROM bars JOIN regimes USING (date)) GROUP BY 1", uses=("bars", "regimes"))
def agg_rare_segments(spark: SparkSession, d: str) -> DataFrame:
    segs = F.array_compact(F.array(F.when(F.col("regime_id") == 0, "rare").otherwise("common"), F.when(F.col("volume") > 1, "busy")))
    df = bars(spark, d).join(regimes(spark, d), "date").select("close", F.explode(segs).alias("segment"))
    return rounded(df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close")), "mean_close", digits=4)


_LAB = "lab AS (SELECT symbol, date, regime_id FROM bars JOIN regimes USING (date))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("symbol", "date").join(regimes(spark, d), "date")


_RUNS = "runs AS (SELECT symbol, regime_id, min(date) AS start, max(date) AS \"end\", count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, regime_id ORDER BY date) AS g FROM lab) GROUP BY symbol, regime_id, g)"


@query("SELECT symbol, regime_id, start, \"end\", length FROM runs", uses=("bars", "regimes"), more=f"{_LAB}, {_RUNS}")
def seq_run_length(spark: SparkSession, d: str) -> DataFrame:
    return ag.run_lengths(_labelled(spark, d), "regime_id", ["symbol"])


@query("SELECT symbol, regime_id, CAST(sum(length) AS BIGINT) AS n, round(avg(length), 6) + 0.0 AS mean_run, round(sum(length) / sum(sum(length)) OVER (PARTITION BY symbol), 6) + 0.0 AS share FROM runs GROUP BY 1, 2", uses=("bars", "regimes"), more=f"{_LAB}, {_RUNS}")
def agg_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    s = ag.run_lengths(_labelled(spark, d), "regime_id", ["symbol"]).groupBy("symbol", "regime_id").agg(F.sum("length").alias("n"), F.avg("length").alias("mean_run"))
    return rounded(s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))), "mean_run", "share")


_PAIRS = "pairs AS (SELECT symbol, regime_id AS label, nx AS next, count(*) AS n FROM (SELECT *, lead(regime_id) OVER (PARTITION BY symbol ORDER BY date) AS nx FROM lab) WHERE nx IS NOT NULL GROUP BY 1, 2, 3)"


@query("SELECT symbol, label, next, n, round(n / sum(n) OVER (PARTITION BY symbol, label), 6) + 0.0 AS p FROM pairs", uses=("bars", "regimes"), more=f"{_LAB}, {_PAIRS}")
def agg_transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.transitions(_labelled(spark, d), "regime_id", ["symbol"]), "p")


@query("SELECT symbol, label, round(sum(-p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY symbol, label) AS p FROM pairs) GROUP BY 1, 2", uses=("bars", "regimes"), more=f"{_LAB}, {_PAIRS}")
def agg_transition_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.transition_entropy(_labelled(spark, d), "regime_id", ["symbol"]), "entropy")


@query("SELECT symbol, regime_id, count(*) AS n, round(avg(CASE WHEN nx = regime_id THEN 0 ELSE 1 END), 6) + 0.0 AS switch_rate FROM (SELECT *, lead(regime_id) OVER (PARTITION BY symbol ORDER BY date) AS nx FROM lab) GROUP BY 1, 2", uses=("bars", "regimes"), more=_LAB)
def agg_switch_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.switch_rate(_labelled(spark, d), "regime_id", ["symbol"]), "switch_rate")


@query("SELECT m, regime_id FROM (SELECT month(date) AS m, regime_id, row_number() OVER (PARTITION BY month(date) ORDER BY count(*) DESC, regime_id) AS n FROM regimes GROUP BY 1, 2) WHERE n = 1", uses=("regimes",))
def agg_modal_map(spark: SparkSession, d: str) -> DataFrame:
    return ag.modal_map(regimes(spark, d).withColumn("m", F.month("date").cast("long")), "m", "regime_id")


_MONTHS = """md AS (SELECT strftime(date, '%Y-%m') AS month, regime_id, median(close) AS mc, median(volume) AS mv FROM bars JOIN regimes USING (date) GROUP BY 1, 2),
  nx AS (SELECT month, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT month FROM md)),
  lb AS (SELECT regime_id, CASE WHEN median(volume) > 1 THEN 'busy' ELSE 'calm' END AS label FROM bars JOIN regimes USING (date) GROUP BY 1),
  ds AS (SELECT a.month, a.regime_id AS a, b.regime_id AS b, round(sqrt((a.mc - b.mc) ** 2 + (a.mv - b.mv) ** 2), 6) AS distance FROM md a JOIN nx ON nx.month = a.month JOIN md b ON b.month = nx.next),
  mt AS (SELECT month, unnest(list_reduce(list([struct_pack(a := a, b := b, distance := distance)] ORDER BY distance, a, b), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x[1].a OR y.b = x[1].b)) > 0 THEN acc ELSE acc || x END)) AS p FROM ds GROUP BY 1)"""


@query("""SELECT month, CAST(p.a AS INTEGER) AS previous, CAST(p.b AS INTEGER) AS current, round(p.distance, 4) + 0.0 AS distance, la.label = lc.label AS kept, round(avg(CASE WHEN la.label = lc.label THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY month), 6) + 0.0 AS kept_rate
  FROM mt JOIN lb la ON la.regime_id = p.a JOIN lb lc ON lc.regime_id = p.b""", uses=("bars", "regimes"), more=_MONTHS)
def agg_monthly_stability(spark: SparkSession, d: str) -> DataFrame:
    """Each month's regimes matched with the next month's, nearest medians first, and whether the match keeps the regime's label."""
    df = bars(spark, d).join(regimes(spark, d), "date")
    return rounded(rounded(ag.monthly_matches(df, "regime_id", ["close", "volume"], F.when(F.percentile("volume", 0.5) > 1, "busy").otherwise("calm")), "distance", digits=4), "kept_rate")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM events GROUP BY 1", uses=())
def agg_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.frequencies(table(spark, d, "events"), ["event_type"]), "share")


@query("SELECT regime_id, count(DISTINCT best) AS n_winners FROM tops GROUP BY 1", uses=("experts", "regimes"), more=_TOP)
def agg_nunique(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d).groupBy("regime_id").agg(F.count_distinct("best").alias("n_winners"))


@query("SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS nation, count(*) AS n, round(avg(c_acctbal), 4) + 0.0 AS mean, round(stddev_samp(c_acctbal), 4) + 0.0 AS sd, round(sum(c_acctbal), 2) + 0.0 AS total, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1, 2", uses=())
def agg_multi_group(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").withColumn("nation", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")))
    x = "c_acctbal"
    out = df.groupBy("c_mktsegment", "nation").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))
    return rounded(rounded(out, "mean", "sd", digits=4), "total", digits=2)


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean, min(value) AS low, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, max(value) AS high FROM events GROUP BY 1", uses=())
def agg_timing_pctl(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(ag.percentiles(table(spark, d, "events"), ["event_type"], "value"), "mean", "p50", "p95"), "total", digits=4)


_SETS = [["step"], ["step", "agent"], ["branch"], []]


def _timings(spark: SparkSession, d: str) -> DataFrame:
    """Events as timings: step by type, agent by user, branch by the hour."""
    return table(spark, d, "events").select(F.col("event_type").alias("step"), F.col("user_id").alias("agent"), F.hour("ts").alias("branch"), F.to_date("ts").alias("day"), "value")


@query("SELECT grouping(step, agent, branch) AS set_id, step, agent, branch, count(value) AS n, round(sum(value), 4) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM t GROUP BY GROUPING SETS ((step), (step, agent), (branch), ())", uses=(), more="t AS (SELECT event_type AS step, user_id AS agent, hour(ts) AS branch, value FROM events)")
def agg_timing_sets(spark: SparkSession, d: str) -> DataFrame:
    """Timings by step, by step and agent, by branch and over all, from sketches of each day."""
    out = tm.percentiles(_timings(spark, d), F.col("day"), ["step", "agent", "branch"], _SETS, "value")
    return rounded(rounded(out, "mean", "p50", "p95"), "total", digits=4)


@query("SELECT branch, round(p, 6) + 0.0 AS p95, greatest(60.0, ceil(0.2 * p)) AS buffer, round(p + greatest(60.0, ceil(0.2 * p)), 6) + 0.0 AS start_offset FROM (SELECT hour(ts) AS branch, quantile_cont(value, 0.95) AS p FROM events GROUP BY GROUPING SETS ((hour(ts)), ()))", uses=())
def agg_start_budget(spark: SparkSession, d: str) -> DataFrame:
    """For each branch and over all."""
    out = tm.start_budget(tm.percentiles(_timings(spark, d), F.col("day"), ["branch"], [["branch"], []], "value"))
    return rounded(out.select("branch", "p95", "buffer", "start_offset"), "p95", "start_offset")


@query("SELECT regime_id, count(*) AS n_rows, round(avg(ratio), 8) + 0.0 AS mean_ratio, round(avg(reward_next), 8) + 0.0 AS mean_reward FROM experts JOIN regimes USING (date) GROUP BY 1", uses=("experts", "regimes"))
def agg_branch_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _log(spark, d).groupBy("regime_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ratio").alias("mean_ratio"), F.avg("reward_next").alias("mean_reward"))
    return rounded(out, "mean_ratio", "mean_reward", digits=8)


@query("SELECT agent, round(avg(CASE WHEN ratio > 0 THEN 1 ELSE 0 END), 6) + 0.0 AS long_rate, round(avg(CASE WHEN abs(ratio) < 0.1 THEN 1 ELSE 0 END), 6) + 0.0 AS flat_rate, round(avg(CASE WHEN ret < 0 THEN 1 ELSE 0 END), 6) + 0.0 AS loss_rate FROM experts GROUP BY 1", uses=("experts",))
def agg_usage_summary(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = experts(spark, d).groupBy("agent").agg(rate(F.col("ratio") > 0).alias("long_rate"), rate(F.abs("ratio") < 0.1).alias("flat_rate"), rate(F.col("ret") < 0).alias("loss_rate"))
    return rounded(out, "long_rate", "flat_rate", "loss_rate")


@query("SELECT *, CASE WHEN corr IS NULL THEN 'FLAT' WHEN corr > 0.99 THEN 'SAME' ELSE 'OK' END AS status FROM (SELECT a.agent AS agent_a, b.agent AS agent_b, count(*) AS n, round(corr(a.ratio, b.ratio), 6) + 0.0 AS corr, round(avg(CASE WHEN a.ratio = b.ratio THEN 1 ELSE 0 END), 6) + 0.0 AS equal_rate FROM experts a JOIN experts b ON a.date = b.date AND a.agent < b.agent GROUP BY 1, 2)", uses=("experts",))
def agg_pair_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.pair_diversity(experts(spark, d)), "corr", "equal_rate")


@query("SELECT symbol, n, coverage, mae, corr, CASE WHEN coverage < 0.5 OR corr IS NULL THEN 'BAD' WHEN coverage < 0.9 OR corr < 0.1 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT symbol, count(*) AS n, 1.0::DOUBLE AS coverage, round(avg(abs(pred_01 - close)), 4) + 0.0 AS mae, round(corr(pred_01, close), 6) + 0.0 AS corr FROM forecasts GROUP BY 1)", uses=("bars", "forecasts"))
def agg_pred_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(ag.prediction_quality(forecasts(spark, d), "pred_01", "close", "symbol"), "mae", digits=4), "corr", "coverage")


@query("""SELECT symbol, k, n, round(mae, 4) + 0.0 AS mae, round(rmse, 4) + 0.0 AS rmse, round(corr, 6) + 0.0 AS corr FROM (SELECT symbol, k, count(a - b) AS n, avg(abs(a - b)) AS mae, sqrt(avg((a - b) * (a - b))) AS rmse, CASE WHEN count(a - b) >= 5 THEN corr(a, b) END AS corr FROM (SELECT symbol, unnest(['same', 'next', 'previous', 'naive']) AS k,
  unnest([pred_01, pred_01, pred_01, lag(close) OVER v]) AS a, unnest([close, lead(close) OVER v, lag(close) OVER v, close]) AS b FROM forecasts WINDOW v AS (PARTITION BY symbol ORDER BY date)) GROUP BY 1, 2)""", uses=("bars", "forecasts"))
def agg_pred_sanity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    p, c = F.col("pred_01"), F.col("close")
    kinds = {"same": (p, c), "next": (p, F.lead(c).over(w)), "previous": (p, F.lag(c).over(w)), "naive": (F.lag(c).over(w), c)}
    long = forecasts(spark, d).select("symbol", F.array(*[F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")) for k, (a, b) in kinds.items()]).alias("x")).select("symbol", F.explode("x").alias("x")).select("symbol", "x.*")
    e = F.col("a") - F.col("b")
    out = long.groupBy("symbol", "k").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("a", "b").alias("corr"))
    return rounded(rounded(out.withColumn("corr", F.when(F.col("n") >= 5, F.col("corr"))), "mae", "rmse", digits=4), "corr")


@query("SELECT symbol, n, round(a, 6) + 0.0 AS a, round(my - a * mx, 3) + 0.0 AS b FROM (SELECT f.symbol, count(*) AS n, stddev_samp(close) / nullif(stddev_samp(pred_20), 0) AS a, avg(close) AS my, avg(pred_20) AS mx FROM forecasts f JOIN (SELECT symbol, max(date) AS e FROM forecasts GROUP BY 1) m ON f.symbol = m.symbol WHERE date > e - 252 GROUP BY 1)", uses=("bars", "forecasts"))
def agg_scale_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(ag.scale_fit(forecasts(spark, d), "pred_20", "close"), "a"), "b", digits=3)


@query("SELECT (SELECT arg_max(agent, struct_pack(a := m, b := agent)) FROM (SELECT agent, round(avg(ret), 9) AS m FROM experts WHERE date < DATE '1996-01-01' GROUP BY 1)) AS fixed_best, round(avg(best_ret), 8) + 0.0 AS oracle_mean, count(*) AS n FROM tops WHERE date >= DATE '1996-01-01'", uses=("experts", "regimes"), more=_TOP)
def agg_fixed_best_oracle(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("1996-01-01").cast("date")
    best = experts(spark, d).where(F.col("date") < cut).groupBy("agent").agg(F.round(F.avg("ret"), 9).alias("m")).agg(F.max_by("agent", F.struct("m", "agent")).alias("fixed_best"))
    oracle = _tops(spark, d).where(F.col("date") >= cut).agg(F.avg("best_ret").alias("oracle_mean"), F.count(F.lit(1)).alias("n"))
    return rounded(best.join(oracle), "oracle_mean", digits=8)  # a row each


@query("SELECT round(exp(sum(ln(1 + mean_ret))), 6) + 0.0 AS equal_weights, round(sum(ln(1 + best_ret)), 6) + 0.0 AS log_oracle FROM (SELECT date, avg(ret) AS mean_ret, max(ret) AS best_ret FROM experts GROUP BY 1)", uses=("experts",))
def agg_policy_compare(spark: SparkSession, d: str) -> DataFrame:
    day = experts(spark, d).groupBy("date").agg(F.avg("ret").alias("m"), F.max("ret").alias("b"))
    out = day.agg(F.exp(F.sum(F.log1p("m"))).alias("equal_weights"), F.sum(F.log1p("b")).alias("log_oracle"))
    return rounded(out, "equal_weights", "log_oracle")


@query("SELECT 'close' AS \"column\", count(*) AS n, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, min(close) AS low, max(close) AS high FROM bars UNION ALL SELECT 'volume', count(*), 0, min(volume), max(volume) FROM bars")
def agg_data_quality(spark: SparkSession, d: str) -> DataFrame:
    return ag.data_quality(bars(spark, d), ["close", "volume"])


@query("SELECT agent, n_missing, round(n_missing / n, 6) + 0.0 AS missing_rate, CASE WHEN n_missing / n > 0.5 THEN 'FAIL' WHEN n_missing > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT a.agent, count(*) AS n, CAST(sum(CASE WHEN e.ret IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM (SELECT * FROM (SELECT DISTINCT agent FROM experts), (SELECT date FROM regimes)) a LEFT JOIN experts e ON a.agent = e.agent AND a.date = e.date GROUP BY 1)", uses=("experts", "regimes"))
def agg_placeholder_audit(spark: SparkSession, d: str) -> DataFrame:
    e = experts(spark, d)
    have = e.join(regimes(spark, d), "date", "left_semi").groupBy("agent").agg(F.count("ret").alias("have"))
    n = regimes(spark, d).agg(F.count(F.lit(1)).alias("n"))
    out = e.select("agent").distinct().join(have, "agent", "left").join(F.broadcast(n)).withColumn("n_missing", F.col("n") - F.coalesce("have", F.lit(0)))  # one row
    rate = F.col("n_missing") / F.col("n")
    return rounded(out.select("agent", "n_missing", rate.alias("missing_rate"), F.when(rate > 0.5, "FAIL").when(F.col("n_missing") > 0, "WARN").otherwise("PASS").alias("verdict")), "missing_rate")


@query("SELECT regime_id, symbol, round(avg(close), 4) + 0.0 AS mean_close, round(avg(volume), 6) + 0.0 AS mean_volume FROM bars JOIN regimes USING (date) GROUP BY 1, 2", uses=("bars", "regimes"))
def agg_context_profile(spark: SparkSession, d: str) -> DataFrame:
    out = bars(spark, d).join(regimes(spark, d), "date").groupBy("regime_id", "symbol").agg(F.avg("close").alias("mean_close"), F.avg("volume").alias("mean_volume"))
    return rounded(rounded(out, "mean_close", digits=4), "mean_volume")


@query("SELECT agent, n, round(hold, 6) + 0.0 AS mean_hold, round(cagr, 6) + 0.0 AS cagr FROM (SELECT m.agent, n, hold, multiple ** (365.25 / days) - 1 AS cagr FROM (SELECT agent, count(*) AS n, exp(sum(ln(1 + ret))) AS multiple, max(date) - min(date) AS days FROM experts GROUP BY 1) m JOIN (SELECT agent, avg(l) AS hold FROM (SELECT agent, count(*) AS l FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY date) - row_number() OVER (PARTITION BY agent, ratio > 0 ORDER BY date) AS g FROM experts) GROUP BY agent, ratio > 0, g) GROUP BY 1) h ON m.agent = h.agent)", uses=("experts",))
def agg_report_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = experts(spark, d)
    m = e.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.exp(F.sum(F.log1p("ret"))).alias("multiple"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    hold = ag.run_lengths(e.withColumn("up", F.col("ratio") > 0), "up", ["agent"]).groupBy("agent").agg(F.avg("length").alias("mean_hold"))
    return rounded(m.join(hold, "agent").select("agent", "n", "mean_hold", (F.pow("multiple", 365.25 / F.col("days")) - 1).alias("cagr")), "mean_hold", "cagr")


_LOGS = """eq AS (SELECT agent, date, CASE WHEN agent <> 'AF' THEN ret END AS ret, ratio - 0.3 AS ratio, exp(sum(ln(1 + ret)) OVER (PARTITION BY agent ORDER BY date)) AS equity, CASE WHEN agent IN ('AF', 'NO') THEN CASE WHEN date >= DATE '1997-01-01' THEN ' Test' ELSE 'train' END END AS split FROM experts),
  cs AS (SELECT *, bool_or(coalesce(lower(trim(split)) = 'test', false)) OVER (PARTITION BY agent) AS has FROM eq),
  tr AS (SELECT *, CASE WHEN has THEN 'split=test' ELSE 'date>=1996-01-01' END AS basis FROM cs WHERE CASE WHEN has THEN coalesce(lower(trim(split)) = 'test', false) ELSE date >= DATE '1996-01-01' END),
  rr AS (SELECT *, CASE WHEN count(ret) OVER (PARTITION BY agent) = 0 THEN round(equity / lag(equity) OVER (PARTITION BY agent ORDER BY date) - 1, 12) ELSE ret END AS r, equity / max(equity) OVER (PARTITION BY agent ORDER BY date) - 1 AS dd, abs(ratio) > 0.01 AS held, sum(CASE WHEN abs(ratio) > 0.01 THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY date) AS run FROM tr),
  hl AS (SELECT agent, avg(n) AS hold FROM (SELECT agent, run, count(*) AS n FROM rr WHERE held GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""SELECT agent, basis, derived, test_days, {r('total_return_pct', 'max_dd_pct', 'avg_daily_ret', 'win_rate', 'sharpe', 'vol_annual', 'avg_hold_days')} FROM (
  SELECT agent, any_value(basis) AS basis, count(ret) = 0 AS derived, count(*) AS test_days, (arg_max(equity, date) / arg_min(equity, date) - 1) * 100 AS total_return_pct, min(dd) * 100 AS max_dd_pct, avg(r) AS avg_daily_ret, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win_rate,
         avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, stddev_samp(r) * sqrt(252) AS vol_annual, any_value(hold) AS avg_hold_days FROM rr LEFT JOIN hl USING (agent) GROUP BY 1)""", uses=("experts",), more=_LOGS)
def agg_report_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Logs with and without a split, and one whose returns are only in its equity."""
    e = experts(spark, d).withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("agent").orderBy("date"))))
    split = F.when(F.col("agent").isin("AF", "NO"), F.when(F.col("date") >= F.lit("1997-01-01").cast("date"), " Test").otherwise("train"))
    log = e.select("agent", "date", split.alias("split"), F.when(F.col("agent") != "AF", F.col("ret")).alias("ret"), "equity", (F.col("ratio") - 0.3).alias("ratio"))
    return rounded(rp.report(log, ["agent"], "1996-01-01"), "total_return_pct", "max_dd_pct", "avg_daily_ret", "win_rate", "sharpe", "vol_annual", "avg_hold_days")


@query("SELECT k AS \"column\", round(avg(abs(p - t)), 4) + 0.0 AS mae, round(corr(p, t), 4) + 0.0 AS corr, count(t) AS n FROM (SELECT unnest(['pred_01', 'pred_05', 'pred_10', 'pred_20']) AS k, unnest([pred_01, pred_05, pred_10, pred_20]) AS p, close AS t FROM forecasts) GROUP BY 1", uses=("bars", "forecasts"))
def agg_calib_quality(spark: SparkSession, d: str) -> DataFrame:
    long = forecasts(spark, d).unpivot(["symbol", "date", "close"], [f"pred_{h:02d}" for h in HORIZONS], "column", "p")
    return rounded(long.groupBy("column").agg(F.avg(F.abs(F.col("p") - F.col("close"))).alias("mae"), F.corr("p", "close").alias("corr"), F.count("close").alias("n")), "mae", "corr", digits=4)


@query("SELECT section, CASE max(l) WHEN 2 THEN 'BAD' WHEN 1 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT c_mktsegment AS section, CASE WHEN c_acctbal < -990 THEN 2 WHEN c_acctbal < -900 THEN 1 ELSE 0 END AS l FROM customer) GROUP BY 1", uses=())
def agg_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_acctbal")
    return au.roll_up(table(spark, d, "customer").select(F.col("c_mktsegment").alias("section"), F.when(c < -990, "BAD").when(c < -900, "WARN").otherwise("OK").alias("status")))


@query("SELECT agent, round(exp(sum(ln(1 + ret))), 6) + 0.0 AS score, CAST(rank() OVER (ORDER BY round(exp(sum(ln(1 + ret))), 6) DESC, agent) AS INTEGER) AS rank FROM experts GROUP BY 1", uses=("experts",))
def agg_agent_score(spark: SparkSession, d: str) -> DataFrame:
    s = rounded(experts(spark, d).groupBy("agent").agg(F.exp(F.sum(F.log1p("ret"))).alias("score")), "score")
    return s.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "agent")))  # a row an agent


@query("SELECT symbol, round(avg(close), 4) + 0.0 AS mean_close, round(stddev_pop(close), 4) + 0.0 AS sd_close, min(close) AS min_close, max(close) AS max_close FROM bars WHERE date <= DATE '1996-12-31' GROUP BY 1")
def agg_scaler_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.scaler_fit(bars(spark, d).where(F.col("date") <= F.lit("1996-12-31").cast("date")), "symbol", ["close"]), "mean_close", "sd_close", digits=4)


@query("SELECT count(*) AS n_differing FROM ((SELECT regime_id, count(*) AS n FROM regimes GROUP BY 1) EXCEPT ALL (SELECT regime_id, count(*) AS n FROM regimes GROUP BY 1))", uses=("regimes",))
def agg_roundtrip_check(spark: SparkSession, d: str) -> DataFrame:
    from barograph.sources.tables import materialize

    df = regimes(spark, d)
    counts = lambda x: x.groupBy("regime_id").agg(F.count(F.lit(1)).alias("n"))
    return counts(df).exceptAll(counts(materialize(df, "labels"))).agg(F.count(F.lit(1)).alias("n_differing"))


@query("""SELECT symbol, round(median(x), 6) + 0.0 AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) + 0.0 AS iqr FROM (SELECT symbol, ln(close) AS x FROM bars) GROUP BY 1""")
def agg_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    p = ag.profile(bars(spark, d).withColumn("x", F.log("close")), "symbol", ["x"])
    return rounded(p.select("symbol", F.col("median_x").alias("median"), F.col("iqr_x").alias("iqr")), "median", "iqr")


@query()
def agg_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy and co-membership of each regime over 20 seeded resamples."""
    return rounded(ag.bootstrap(regimes(spark, d), "regime_id"), "occupancy_mean", "occupancy_std", "bootstrap_stability", "co_membership_stability")


@query()
def agg_robust_pca(spark: SparkSession, d: str) -> DataFrame:
    """Two components of robustly scaled daily features of each symbol."""
    df = ft.returns(ft.atr_norm(ft.volume(bars(spark, d))), (1, 5)).dropna(subset=["ret_1", "ret_5"])
    out = ag.robust_pca(df, ["atr_norm", "rvol20", "ret_1", "ret_5"], 2)
    return rounded(out.select("symbol", "date", "pc_1", "pc_2"), "pc_1", "pc_2", digits=4)


@query("SELECT DISTINCT symbol, split_part(c, ':', 1) AS profile, split_part(c, ':', 2) AS name FROM (SELECT symbol, unnest(['A:gap', 'A:atr_norm', 'B:gap', 'B:atr_norm', 'B:ret_1', 'B:ret_5', 'C:gap', 'C:atr_norm', 'C:ret_1', 'C:ret_5', 'C:rsi', 'D:atr_norm', 'D:gap', 'D:ret_1', 'D:ret_5', 'D:rsi', 'D:tr']) AS c FROM bars)")
def proj_obs_profile(spark: SparkSession, d: str) -> DataFrame:
    """The columns that each nested profile takes of a table that also has prices and labels."""
    df = sq.rsi(ft.returns(ft.atr_norm(ft.gap(bars(spark, d))), (1, 5)))
    df = df.withColumns({"close_next": F.col("close"), "label_up": F.lit(1)})
    names = [F.struct(F.lit(p).alias("profile"), F.lit(c).alias("name")) for p in "ABCD" for c in ft.observation_columns(df, p, "emb_")]
    return df.select("symbol").distinct().select("symbol", F.explode(F.array(*names)).alias("x")).select("symbol", "x.*")


_LOGGED = """eqs AS (SELECT *, coalesce(lag(reward_next) OVER (PARTITION BY agent ORDER BY date), 0) AS honest, max(date) OVER (PARTITION BY agent) AS last FROM experts),
  led AS (SELECT *, CASE WHEN agent = 'NO' AND date = last THEN honest + 0.01 ELSE honest END AS logged FROM eqs),
  logged AS (SELECT *, exp(sum(ln(1 + honest)) OVER (PARTITION BY agent ORDER BY date)) * 2 AS equity FROM led)"""


def _with_a_leak(spark: SparkSession, d: str) -> DataFrame:
    """The log, of which one agent's last return is not what was announced; equity as it was without that."""
    w = Window.partitionBy("agent").orderBy("date")
    log = sq.expert_log(experts(spark, d)).withColumn("equity", 2 * F.exp(F.sum(F.log1p("logged")).over(w)))
    last = F.col("date") == F.max("date").over(Window.partitionBy("agent"))
    return log.withColumn("logged", F.when((F.col("agent") == "NO") & last, F.col("logged") + 0.01).otherwise(F.col("logged")))


@query("""SELECT agent, round(max(e), 9) + 0.0 AS max_error, arg_max(date, struct_pack(a := round(e, 12), b := date)) AS worst_date, round(any_value(q), 6) + 0.0 AS equity_error, max(e) <= 1e-12 AND any_value(q) <= 1e-10 AS ok FROM (
  SELECT *, abs(logged - lag(reward_next) OVER (PARTITION BY agent ORDER BY date)) AS e, max(abs(re * (f / fr) - equity) / greatest(equity, re * (f / fr), 1e-12)) OVER (PARTITION BY agent) AS q FROM (
    SELECT *, first_value(equity) OVER v AS f, first_value(re) OVER v AS fr FROM (SELECT *, exp(sum(ln(1 + logged)) OVER (PARTITION BY agent ORDER BY date)) AS re FROM logged) WINDOW v AS (PARTITION BY agent ORDER BY date))) WHERE e IS NOT NULL GROUP BY 1""", uses=("experts",), more=_LOGGED)
def audit_reward_align(spark: SparkSession, d: str) -> DataFrame:
    """A log with one planted leak: its agent fails on the return and on the equity, the others pass."""
    return rounded(rounded(au.reward_alignment(_with_a_leak(spark, d), equity="equity"), "max_error", digits=9), "equity_error")


@query("SELECT agent, count(*) AS n, round(max(e), 9) + 0.0 AS max_error, CAST(sum(CASE WHEN e > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS n_off FROM (SELECT agent, abs(ret - (greatest(ratio, 0) * 0.01 + greatest(-ratio, 0) * -0.01 - 0)) AS e FROM experts) GROUP BY 1", uses=("experts",))
def audit_market_align(spark: SparkSession, d: str) -> DataFrame:
    log = experts(spark, d).withColumns({"r_long": F.lit(0.01), "r_short": F.lit(-0.01), "cost": F.lit(0.0)})
    return rounded(au.market_alignment(log), "max_error", digits=9)


_SHIFTS = (-2, -1, 0, 1, 2, 3)


@query(f"""SELECT agent, k, n, {r('mae', digits=9)}, {r('corr', 'equity_end', 'max_dd')}, CAST(row_number() OVER (PARTITION BY agent ORDER BY round(mae, 12), k) AS INTEGER) AS rank FROM (
  SELECT agent, k, count(*) AS n, avg(abs(t - g)) AS mae, corr(t, g) AS corr, arg_max(eq, date) AS equity_end, min(eq / peak - 1) AS max_dd FROM (
    SELECT *, max(eq) OVER (PARTITION BY agent, k ORDER BY date) AS peak FROM (SELECT *, exp(sum(ln(1 + g)) OVER (PARTITION BY agent, k ORDER BY date)) AS eq FROM (
      SELECT agent, date, ratio * ret AS t, unnest({list(_SHIFTS)}) AS k, unnest([{", ".join(f"lag(ratio, {k}) OVER v * ret" if k >= 0 else f"lead(ratio, {-k}) OVER v * ret" for k in _SHIFTS)}]) AS g FROM experts WINDOW v AS (PARTITION BY agent ORDER BY date)) WHERE g IS NOT NULL)) GROUP BY 1, 2)""", uses=("experts",))
def audit_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Six guesses of which day's position earned a return, ranked, with the equity and drawdown that each would have made."""
    log = experts(spark, d).withColumn("target", F.col("ratio") * F.col("ret"))
    return rounded(rounded(au.lag_hypotheses(log, "ratio", "ret", "target", "agent", _SHIFTS), "mae", digits=9), "corr", "equity_end", "max_dd")


_IMPLIED = {"own": "x / p", "own_cost": "(x + cost) / p", "before": "x / pp", "before_cost": "(x + cost) / pp"}
_RETURNS = {"oc_same": "close / open - 1", "cc_same": "close / lc - 1", "oc_next": "nc / no - 1", "cc_next": "nc / close - 1"}


@query(f"""SELECT symbol, implied, definition, n, {r('mae', 'rmse', 'corr')}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(coalesce(corr, -1), 6) DESC, round(rmse, 6), round(mae, 6), n DESC, implied, definition) AS INTEGER) AS rank FROM (
  SELECT symbol, implied, definition, count(a - b) AS n, avg(abs(a - b)) AS mae, sqrt(avg((a - b) * (a - b))) AS rmse, corr(a, b) AS corr FROM (
    SELECT symbol, implied, a, unnest({list(_RETURNS)}) AS definition, unnest([{", ".join(_RETURNS.values())}]) AS b FROM (
      SELECT *, unnest({list(_IMPLIED)}) AS implied, unnest([{", ".join(_IMPLIED.values())}]) AS a FROM (
        SELECT *, lag(p) OVER v AS pp, lag(p) OVER v * (close / lag(close) OVER v - 1) - 0.001 * coalesce(abs(p - lag(p) OVER v), 0) AS x, 0.001 * coalesce(abs(p - lag(p) OVER v), 0) AS cost, lag(close) OVER v AS lc, lead(close) OVER v AS nc, lead(open) OVER v AS no
        FROM (SELECT *, 0.5 + (day(date) % 4) / 8 AS p FROM bars) WINDOW v AS (PARTITION BY symbol ORDER BY date)))) GROUP BY 1, 2, 3)""")
def audit_implied_ret(spark: SparkSession, d: str) -> DataFrame:
    """Returns that a log of positions implies, against four definitions of a day's return: the log earned the change of closes on the position of the day before, less costs."""
    w = Window.partitionBy("symbol").orderBy("date")
    log = bars(spark, d).withColumn("pos", 0.5 + (F.day("date") % 4) / 8)
    cost = 0.001 * F.coalesce(F.abs(F.col("pos") - F.lag("pos").over(w)), F.lit(0.0))
    log = log.withColumn("cost", cost).withColumn("ret", F.lag("pos").over(w) * (F.col("close") / F.lag("close").over(w) - 1) - F.col("cost"))
    return rounded(au.implied_returns(log), "mae", "rmse", "corr")


@query(f"SELECT symbol, count(x) AS n_known, count(x) = 0 AS ok FROM (SELECT symbol, {over('avg', 'close', 14, 14)} AS x, row_number() OVER {W} AS n FROM bars) WHERE n <= 13 GROUP BY 1")
def audit_no_backfill(spark: SparkSession, d: str) -> DataFrame:
    from barograph.functions.windows import roll

    return au.no_backfill(bars(spark, d).withColumn("x", roll(F.avg, "close", 14, 14)), "x", 13)


@query(f"""SELECT 'reward' AS audit, count(*) AS n, bool_and(ok) AS ok FROM (SELECT max(abs(logged - p)) <= 1e-12 AS ok FROM (SELECT *, lag(reward_next) OVER (PARTITION BY agent ORDER BY date) AS p FROM logged) GROUP BY agent) UNION ALL SELECT 'backfill', count(DISTINCT symbol), true FROM bars""", uses=("bars", "experts"), more=_LOGGED)
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok")).select(F.lit(name).alias("audit"), "n", "ok")
    return one("reward", audit_reward_align(spark, d)).unionByName(one("backfill", audit_no_backfill(spark, d)))
