"""Routing of days to agents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.operators import aggregates as ag
from barograph.operators import routing as rt
from barograph.operators import sequential as sq
from barograph.plans.aggregate_queries import _EDGES, _log, ranks_of
from barograph.plans.registry import query, r, rounded
from barograph.plans.sequence_queries import _SOFT
from barograph.sources.bars import experts
from barograph.sources.tables import materialize, table

SAFE = ("NO",)
FIRST_DAY = "1996-01-01"
_LOG = "log AS (SELECT e.*, regime_id FROM experts e JOIN regimes USING (date))"
_MORE = f"""{_EDGES}, {_LOG},
  full_edges AS (SELECT e.*, dd_proxy, n_global FROM edges e JOIN (SELECT regime_id, agent, min(eq / pk - 1) AS dd_proxy FROM (SELECT *, max(eq) OVER (PARTITION BY regime_id, agent ORDER BY date) AS pk FROM (
    SELECT regime_id, agent, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY regime_id, agent ORDER BY date)) AS eq FROM log)) GROUP BY 1, 2) USING (regime_id, agent) JOIN (SELECT agent, count(*) AS n_global FROM log GROUP BY 1) USING (agent)),
  best_of_all AS (SELECT list_distinct_in_order AS b FROM (SELECT list(agent ORDER BY ir_global DESC, ev_global DESC, n_global DESC, agent)[1:2] AS list_distinct_in_order FROM (SELECT DISTINCT agent, ir_global, ev_global, n_global FROM full_edges))),
  good AS (SELECT * FROM (SELECT *, max(CASE WHEN ev_shrink > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY regime_id) AS any_good FROM full_edges) WHERE any_good = 0 OR ev_shrink > 0),
  high AS (SELECT *, sum(h) OVER (PARTITION BY regime_id) AS kept FROM (SELECT *, CASE WHEN ev_shrink >= quantile_cont(ev_shrink, 0.25) OVER (PARTITION BY regime_id) THEN 1 ELSE 0 END AS h, count(*) OVER (PARTITION BY regime_id) AS n FROM good)),
  picked AS (SELECT regime_id, list(agent ORDER BY ir_shrink DESC, ev_shrink DESC, dd_proxy, n_days DESC, agent)[1:2] AS p FROM high WHERE n < 4 OR kept < 2 OR h = 1 GROUP BY 1),
  lists AS (SELECT regime_id, ['NO'] || list_filter(CASE WHEN days < 10 THEN b ELSE p END, lambda x: x <> 'NO') AS allowed FROM picked JOIN (SELECT regime_id, max(n_days) AS days FROM edges GROUP BY 1) USING (regime_id), best_of_all
    UNION ALL SELECT -1, ['NO'] || list_filter(b, lambda x: x <> 'NO') FROM best_of_all),
  days AS (SELECT g.date, g.regime_id, g.a AS ranked, coalesce(l.allowed, (SELECT allowed FROM lists WHERE regime_id = -1)) AS allowed, g.w[1].agent AS winner, g.w[1].ret AS top1_ret, coalesce(g.w[1].ret - g.w[2].ret, 0) AS margin, g.regime_id = 2 AS rare FROM (
    SELECT date, g.regime_id, list(g.agent ORDER BY coalesce(ir_shrink, 0) DESC, g.agent) AS a, list(coalesce(ir_shrink, 0) ORDER BY coalesce(ir_shrink, 0) DESC, g.agent) AS s, list(struct_pack(agent := g.agent, ret := g.ret) ORDER BY g.ret DESC, g.agent) AS w
    FROM log g LEFT JOIN edges e ON e.regime_id = g.regime_id AND e.agent = g.agent GROUP BY 1, 2) g LEFT JOIN lists l ON l.regime_id = g.regime_id)"""
_USES = ("experts", "regimes")


class Base(NamedTuple):
    """What the routing queries share, each written once, so that no plan reads the tables again for every use."""

    log: DataFrame
    edges: DataFrame
    lists: DataFrame


def base(spark: SparkSession, d: str) -> Base:
    log = materialize(_log(spark, d), "log")
    edges = materialize(rt.with_dd_proxy(ag.edge_table(log), log), "edges")
    return Base(log, edges, materialize(rt.allow_lists(edges, SAFE, top=2), "lists"))


def _days(b: Base) -> DataFrame:
    """Days with an even confidence; days of regime 2 count as rare."""
    days = rt.days_of(b.log, b.edges, b.lists).withColumns({"rare": F.col("regime_id") == 2, "confidence": F.lit(1.0)})
    return materialize(days, "days")


@query("SELECT CAST(regime_id AS INTEGER) AS regime_id, array_to_string(allowed, '|') AS allowed_agents FROM lists", uses=_USES, more=_MORE)
def seq_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).lists.select("regime_id", F.array_join("allowed", "|").alias("allowed_agents"))


@query("""SELECT date, policy, c[1] AS chosen, array_to_string(c, '|') AS candidates, list_contains(c, winner) AS covered, list_contains(c, winner) AND NOT list_contains(allowed, winner) AS rescued FROM (
  SELECT date, winner, allowed, unnest(['hard_cut', 'penalty', 'expansion']) AS policy, unnest([CASE WHEN len(own) > 0 THEN own ELSE ranked[1:1] END, low, CASE WHEN len(own) = 0 AND NOT wide THEN ranked[1:1] WHEN wide THEN own || others[1:2] ELSE own END]) AS c FROM (
    SELECT *, list_filter(ranked, lambda x: list_contains(allowed, x)) AS own, list_filter(ranked, lambda x: NOT list_contains(allowed, x)) AS others, rare OR abs(margin) <= 0.0015 AS wide
    FROM days JOIN (SELECT g.date, list(g.agent ORDER BY coalesce(ir_shrink, 0) - CASE WHEN list_contains(d.allowed, g.agent) THEN 0 ELSE 0.15 END DESC, coalesce(ir_shrink, 0) DESC, g.agent) AS low FROM log g JOIN days d ON d.date = g.date LEFT JOIN edges e ON e.regime_id = g.regime_id AND e.agent = g.agent GROUP BY 1) USING (date)))""", uses=_USES, more=_MORE)
def seq_fallback_policy(spark: SparkSession, d: str) -> DataFrame:
    return rt.fallback_policies(_days(base(spark, d)))


_MARKET = "market AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) - 0.05, 8) AS r_long, round(0.05 - avg(l_discount), 8) AS r_short FROM lineitem GROUP BY 1)"


def _market(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("x"))
    return items.select("date", F.round(F.col("x") - 0.05, 8).alias("r_long"), F.round(0.05 - F.col("x"), 8).alias("r_short"))


@query()
def seq_fallback_rates(spark: SparkSession, d: str) -> DataFrame:
    """Of each policy: coverage, misses, rescues, mean return on rare days, mean change of the position, final equity."""
    b = base(spark, d)
    log, days = b.log, _days(b)
    each = materialize(rt.fallback_policies(days), "policies")
    rates = each.groupBy("policy").agg(F.avg(F.col("covered").cast("int")).alias("coverage"), F.avg((~F.col("covered")).cast("int")).alias("miss_rate"), F.avg(F.col("rescued").cast("int")).alias("rescued_rate"))
    own = each.join(log.select("date", F.col("agent").alias("chosen"), "ratio"), ["date", "chosen"], "left")
    book = rt.pair_simulation(own.select("policy", "date", "ratio", F.lit(1.0).alias("weight")), _market(spark, d), by=["policy"]).join(days.select("date", "rare"), "date")
    out = book.groupBy("policy").agg(F.avg(F.when(F.col("rare"), F.col("ret"))).alias("rare_ret"), F.avg("turnover").alias("churn"), F.max_by("equity", "date").alias("equity_end"))
    return rounded(rates.join(out, "policy"), "coverage", "miss_rate", "rescued_rate", "rare_ret", "churn", "equity_end")


@query(f"""SELECT date, regime_id, chosen, winner, list_contains(allowed, winner) AS covered, CAST(coalesce(rank, -1) AS INTEGER) AS winner_rank, own AS ret, round(coalesce(fixed, 0) - own, 8) + 0.0 AS regret_fixed, round(top1_ret - own, 8) + 0.0 AS regret_oracle,
  CASE WHEN chosen <> winner AND list_contains(allowed, winner) THEN 'router' WHEN NOT list_contains(allowed, winner) THEN 'fallback' WHEN chosen <> winner AND abs(margin) <= 0.0015 THEN 'hard_routing' WHEN mix >= 3 THEN 'cluster_granularity' WHEN rare THEN 'rare_policy' END AS label
  FROM days JOIN (SELECT date, arg_max(agent, struct_pack(w := round(raw_w, 9), n := agent)) AS chosen FROM soft GROUP BY 1) USING (date) JOIN (SELECT regime_id, count(DISTINCT winner) AS mix FROM days GROUP BY 1) USING (regime_id)
  LEFT JOIN (SELECT date, agent, ret AS own FROM experts) o ON o.date = days.date AND o.agent = chosen LEFT JOIN (SELECT date, ret AS fixed FROM experts WHERE agent = (SELECT arg_max(agent, struct_pack(m := m, n := agent)) FROM (SELECT agent, round(avg(ret), 9) AS m FROM experts WHERE date < DATE '{FIRST_DAY}' GROUP BY 1))) f ON f.date = days.date
  LEFT JOIN (SELECT regime_id, agent, row_number() OVER (PARTITION BY regime_id ORDER BY round(ir, 9) DESC, round(ev, 9) DESC, agent) AS rank FROM edges) k ON k.regime_id = days.regime_id AND k.agent = winner""".replace("SELECT date, regime_id, chosen", "SELECT days.date, days.regime_id, chosen", 1), uses=_USES, more=f"{_MORE}, {_SOFT}")
def seq_usage_audit(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    log = b.log
    soft = sq.daily_softmax(log, b.edges)
    chosen = soft.groupBy("date").agg(F.max_by("agent", F.struct(F.round("raw_w", 9), "agent")).alias("chosen"))
    means = experts(spark, d).where(F.col("date") < F.lit(FIRST_DAY).cast("date")).groupBy("agent").agg(F.round(F.avg("ret"), 9).alias("m"))
    fixed = means.agg(F.max_by("agent", F.struct("m", "agent")).alias("agent"))
    out = rt.usage_audit(_days(b), log, chosen, ranks_of(b.edges), fixed, 4)
    return rounded(out, "regret_fixed", "regret_oracle", digits=8)


@query(f"SELECT date, agent, round(exp(grown - mx) / sum(exp(grown - mx)) OVER (PARTITION BY date), 6) + 0.0 AS weight FROM (SELECT *, max(grown) OVER (PARTITION BY date) AS mx FROM s)", uses=("experts",), recursive=True, more=f"""grid AS (
  SELECT d.date, a.agent, coalesce(e.ret, 0) AS ret, coalesce(a.p, 0) AS p, row_number() OVER (PARTITION BY a.agent ORDER BY d.date) AS i FROM (SELECT DISTINCT date FROM experts WHERE date >= DATE '{FIRST_DAY}') d CROSS JOIN (SELECT agent, avg(ret) FILTER (date < DATE '{FIRST_DAY}') AS p FROM experts GROUP BY 1) a LEFT JOIN experts e ON e.date = d.date AND e.agent = a.agent),
  s AS (SELECT agent, date, i, p AS grown, 0.35 * ret + 0.65 * p AS m FROM grid WHERE i = 1 UNION ALL SELECT g.agent, g.date, g.i, s.grown + 4.0 * s.m, 0.35 * g.ret + 0.65 * s.m FROM s JOIN grid g ON g.agent = s.agent AND g.i = s.i + 1)""")
def seq_adaptive_router(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rt.adaptive_weights(experts(spark, d), FIRST_DAY), "weight")


def _router(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    log, edges = b.log, b.edges
    scored = log.join(edges.select("regime_id", "agent", F.col("ir_shrink").alias("score")), ["regime_id", "agent"], "left")
    days = scored.groupBy("date", "regime_id").agg(F.collect_list(F.struct("agent", "ratio", "ret", "score")).alias("agents"))
    days = days.join(b.lists, "regime_id", "left").join(_market(spark, d), "date", "left")
    return rt.router_simulation(days, cap=0.6, l2=0.001, spread=rt.score_spread(edges), safe=SAFE)


@query()
def seq_router_sim(spark: SparkSession, d: str) -> DataFrame:
    numbers = ["ratio", "turnover", "cost", "churn", "ret_selected", "ret_best", "reward", "weight", "equity"]
    return rounded(_router(spark, d), *numbers)


@query()
def publish_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The best reward mode's daily log, published only once every mode's is complete, and read back from its place."""
    from barograph.sources import files as fs

    sim = materialize(_router(spark, d), "router")
    place = fs.publish_best(sim, rt.reward_mode_ranks(sim), "mode", rt.MODES)
    return rounded(fs.published(spark, place).select("mode", "date", "ratio", "equity"), "ratio", "equity")
