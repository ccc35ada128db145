"""Routing of days to agents: allow-lists, fallback policies, adaptive weights, the router's simulation and its audit.

A book has a row a day and agent, so what runs along it is bounded by the calendar; books and reward modes spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.operators.aggregates import with_drawdown

MODES = ("legacy", "profit_basic", "profit_regret", "profit_light_risk")


def with_dd_proxy(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Adds dd_proxy (worst drawdown of the agent on the regime's days alone) and n_global (the agent's days)."""
    dd = with_drawdown(log, ["regime_id", "agent"]).groupBy("regime_id", "agent").agg(F.min("drawdown").alias("dd_proxy"))
    days = log.groupBy("agent").agg(F.count(F.lit(1)).alias("n_global"))
    return edges.join(dd, ["regime_id", "agent"]).join(days, "agent")


def allow_lists(edges: DataFrame, safe: tuple[str, ...] = (), top: int = 3, least_days: int = 10) -> DataFrame:
    """regime_id, allowed (array): the safe agents, then the best of the regime; -1 stands for an unknown regime.

    Of agents with a positive EV (of all where none has one), the lowest quartile goes where four or more are left and two
    remain; then the best by IR, EV, drawdown and days. A regime of fewer than ``least_days`` gets the agents that are best
    over all regimes.
    """
    order = F.struct(-F.col("ir_shrink"), -F.col("ev_shrink"), F.col("dd_proxy"), -F.col("n_days"), F.col("agent").alias("agent"))
    everywhere = edges.select("agent", "ir_global", "ev_global", "n_global").distinct()
    best = F.slice(F.array_sort(F.collect_list(F.struct(-F.col("ir_global"), -F.col("ev_global"), -F.col("n_global"), F.col("agent").alias("agent")))), 1, top)
    everywhere = everywhere.agg(F.transform(best, lambda x: x["agent"]).alias("best_of_all"))  # one row
    w = Window.partitionBy("regime_id")
    some = edges.withColumn("_good", F.max((F.col("ev_shrink") > 0).cast("int")).over(w)).where((F.col("ev_shrink") > 0) | (F.col("_good") == 0))
    cut = some.groupBy("regime_id").agg(F.count(F.lit(1)).alias("_n"), F.percentile("ev_shrink", 0.25).alias("_q"))
    some = some.join(cut, "regime_id").withColumn("_high", (F.col("ev_shrink") >= F.col("_q")).cast("int"))
    some = some.withColumn("_left", F.sum("_high").over(w)).where((F.col("_n") < 4) | (F.col("_left") < 2) | (F.col("_high") == 1))
    picked = some.groupBy("regime_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, top), lambda x: x["agent"]).alias("picked"))
    days = edges.groupBy("regime_id").agg(F.max("n_days").alias("_days")).where("regime_id <> -1")
    known = days.join(picked, "regime_id").crossJoin(F.broadcast(everywhere))
    first = F.array(*[F.lit(a) for a in safe]).cast("array<string>")
    known = known.select("regime_id", F.array_distinct(F.concat(first, F.when(F.col("_days") < least_days, F.col("best_of_all")).otherwise(F.col("picked")))).alias("allowed"))
    return known.unionByName(everywhere.select(F.lit(-1).alias("regime_id"), F.array_distinct(F.concat(first, "best_of_all")).alias("allowed")))


def days_of(log: DataFrame, edges: DataFrame, allowed: DataFrame, score: str = "ir_shrink") -> DataFrame:
    """A row a day: regime_id, ranked (array of struct(neg, agent), best score first), allowed, winner, top1_ret, margin.

    A regime without a list gets that of -1. An agent without a score has 0. Of equal returns the first agent by name wins.
    """
    scored = log.join(edges.select("regime_id", "agent", F.col(score).alias("_score")), ["regime_id", "agent"], "left")
    days = scored.groupBy("date", "regime_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.coalesce("_score", F.lit(0.0))).alias("neg"), "agent"))).alias("ranked"),
        F.array_sort(F.collect_list(F.struct((-F.col("ret")).alias("neg"), "agent"))).alias("_won"),
    )
    other = allowed.where("regime_id = -1").agg(F.first("allowed").alias("_other"))  # one row
    days = days.join(allowed.where("regime_id <> -1"), "regime_id", "left").crossJoin(F.broadcast(other))
    first, second = F.col("_won")[0], F.get("_won", F.lit(1))
    margin = F.coalesce(second["neg"] - first["neg"], F.lit(0.0))
    return days.select("date", "regime_id", "ranked", F.coalesce("allowed", "_other").alias("allowed"), first["agent"].alias("winner"), (-first["neg"]).alias("top1_ret"), margin.alias("margin"))


POLICIES = ("hard_cut", "penalty", "expansion")


def fallback_policies(days: DataFrame, penalty: float = 0.15, confidence: float = 0.55, margin: float = 0.0015, extra: int = 2) -> DataFrame:
    """date, policy, chosen, candidates, covered (the winner is one), rescued (it is, though not allowed).

    hard_cut takes the allowed agents alone; penalty takes all, those not allowed with a lower score; expansion adds the
    best ``extra`` of the others on rare, uncertain or close days. Without a candidate the best agent is one.
    ``days``: of ``days_of``, with columns rare (boolean) and confidence.
    """
    inside = lambda x: F.array_contains("allowed", x["agent"])
    own, others = F.filter("ranked", inside), F.filter("ranked", lambda x: ~inside(x))
    or_best = lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice("ranked", 1, 1))
    lowered = F.array_sort(F.transform("ranked", lambda x, i: F.struct((x["neg"] + F.when(inside(x), 0.0).otherwise(penalty)).alias("neg"), i.alias("i"), x["agent"].alias("agent"))))
    wide = F.col("rare") | (F.col("confidence") <= confidence) | (F.abs("margin") <= margin)
    names = lambda x: F.transform(x, lambda y: y["agent"])
    of = {
        "hard_cut": names(or_best(own)),
        "penalty": names(lowered),
        "expansion": names(or_best(F.when(wide, F.concat(own, F.slice(others, 1, extra))).otherwise(own))),
    }
    each = days.select("date", "winner", "allowed", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), of[p].alias("candidates")) for p in POLICIES])).alias("p")).select("date", "winner", "allowed", "p.*")
    covered = F.array_contains("candidates", F.col("winner"))
    return each.select("date", "policy", F.col("candidates")[0].alias("chosen"), F.array_join("candidates", "|").alias("candidates"), covered.alias("covered"), (covered & ~F.array_contains("allowed", F.col("winner"))).alias("rescued"))


def usage_audit(days: DataFrame, log: DataFrame, chosen: DataFrame, ranks: DataFrame, fixed_best: DataFrame, n_agents: int, margin: float = 0.0015, confidence: float = 0.55) -> DataFrame:
    """date, regime_id, chosen, winner, covered, winner_rank, ret, regret_fixed, regret_oracle, label of each day.

    ``chosen`` (date, chosen), ``ranks`` (regime_id, agent, rank), ``fixed_best`` (one row: agent). The label is the first that
    holds: router (the winner was allowed but not chosen), fallback (it was not allowed), hard_routing (a close day),
    cluster_granularity (the regime has many winners), rare_policy; else null.
    """
    mix = days.groupBy("regime_id").agg(F.count_distinct("winner").alias("_mix"))
    own = log.select("date", F.col("agent").alias("chosen"), F.col("ret").alias("_own"))
    fixed = log.join(F.broadcast(fixed_best), "agent").select("date", F.col("ret").alias("_fixed"))  # one agent
    out = days.join(chosen, "date").join(mix, "regime_id").join(own, ["date", "chosen"], "left").join(fixed, "date", "left")
    out = out.join(ranks.select("regime_id", F.col("agent").alias("winner"), F.col("rank").alias("winner_rank")), ["regime_id", "winner"], "left")
    covered, off = F.array_contains("allowed", F.col("winner")), F.col("chosen") != F.col("winner")
    close = (F.abs("margin") <= margin) | (F.col("confidence") <= confidence) | F.col("rare")
    label = (
        F.when(off & covered, "router").when(~covered, "fallback").when(off & close & (F.abs("margin") <= margin), "hard_routing")
        .when(F.col("_mix") >= max(3, n_agents // 3), "cluster_granularity").when(F.col("rare"), "rare_policy")
    )
    ret = F.coalesce("_own", F.lit(0.0))
    return out.select("date", "regime_id", "chosen", "winner", covered.alias("covered"), F.coalesce("winner_rank", F.lit(-1)).alias("winner_rank"), ret.alias("ret"), (F.coalesce("_fixed", F.lit(0.0)) - ret).alias("regret_fixed"), (F.col("top1_ret") - ret).alias("regret_oracle"), label.alias("label"))


def adaptive_weights(log: DataFrame, first_day: str, alpha: float = 0.35, eta: float = 4.0) -> DataFrame:
    """date, agent, weight from ``first_day`` on: wealth grows by exp(eta * m) a day, with m an exponential mean of returns.

    Wealth and mean begin at the agent's mean return before that day. A day without a return counts as 0.
    """
    start = F.lit(first_day).cast("date")
    prior = log.groupBy("agent").agg(F.coalesce(F.avg(F.when(F.col("date") < start, F.col("ret"))), F.lit(0.0)).alias("prior"))
    days = log.where(F.col("date") >= start).select("date").distinct()
    grid = days.crossJoin(F.broadcast(prior)).join(log.select("date", "agent", "ret"), ["date", "agent"], "left")  # a row a day and agent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        prior_ = pdf["prior"].iloc[0]
        mean = pd.concat([pd.Series([prior_]), pdf["ret"].fillna(0.0)], ignore_index=True).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        # Wealth of a day has grown by the means of the days before it.
        grown = prior_ + eta * (np.cumsum(mean[1:]) - mean[1:])
        return pd.DataFrame({"date": pdf["date"], "agent": pdf["agent"], "grown": grown})

    logs = grid.groupBy("agent").applyInPandas(run, "date date, agent string, grown double")
    day = Window.partitionBy("date")
    logs = logs.withColumn("_e", F.exp(F.col("grown") - F.max("grown").over(day)))
    return logs.select("date", "agent", (F.col("_e") / F.sum("_e").over(day)).alias("weight"))


def pair_simulation(weights: DataFrame, market: DataFrame, cost_bps: float = 15.0, by: list[str] | None = None) -> DataFrame:
    """date, pos, turnover, cost, ret, equity of each book ``by`` (one if not given) that holds the weighted ratio: above 0 the long, below 0 the short side.

    ``weights``: (by, date, ratio, weight) rows; ``market``: (date, r_long, r_short), missing ones 0.
    """
    by = by or []
    days = weights.groupBy(*by, "date").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("weight") * F.coalesce("ratio", F.lit(0.0))))).alias("pos")).join(market, "date", "left")
    w = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)]).orderBy("date")  # a book has a row a day
    days = days.withColumn("turnover", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    gross = F.greatest("pos", F.lit(0.0)) * F.coalesce("r_long", F.lit(0.0)) + F.greatest(-F.col("pos"), F.lit(0.0)) * F.coalesce("r_short", F.lit(0.0))
    days = days.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("ret", gross - F.col("cost"))
    return days.select(*by, "date", "pos", "turnover", "cost", "ret", F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


def _capped(w: np.ndarray, cap: float) -> np.ndarray:
    """Weights of sum 1 cut at the cap and scaled again until none is above it (or above an equal share)."""
    if cap >= 1:
        return w
    active = max(1, int((w > 1e-9).sum()))
    cap = max(cap, 1 / active)
    for _ in range(active + 1):
        w = np.minimum(w, cap)
        if w.sum() <= 0:
            return w
        w = w / w.sum()
        if (w <= cap + 1e-9).all():
            break
    return w


def raw_weights(scores: np.ndarray, beta: float, spread: float) -> np.ndarray:
    """Softmax of the scores with a beta that falls as they spread more than all regimes' scores do; equal if one is unknown."""
    if np.isnan(scores).any():
        return np.full(len(scores), 1 / max(1, len(scores)))
    own = scores.std() if len(scores) > 1 else spread
    beta = float(np.clip(beta / (1 + own / max(spread, 1e-9)), beta / 2, beta * 2))
    z = np.exp(beta * (scores - scores.max()))
    return z / z.sum()


def router_simulation(days: DataFrame, modes: tuple[str, ...] = MODES, beta: float = 5.0, ema: float = 0.3, smooth: float = 0.7, cap: float = 1.0, limit: float = 1.0, cost_bps: float = 15.0, l2: float = 0.0, switch: float = 0.0005, churn: float = 0.0002, regret: float = 0.2, drawdown: float = 0.05, spread: float = 1.0, safe: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """The router over a book's days, once for each reward mode.

    ``days``: date, regime_id, r_long, r_short, allowed (array), and agents (array of struct(agent, ratio, ret, score)). Weights are
    the softmax of the allowed agents' scores, followed by an exponential mean, capped; the position follows the weighted
    ratio likewise. A regime without a list (null) may use all agents. Of regime -1 the safe agents count; they also do where no
    allowed agent is left, and without a safe one all do. ``excluded`` agents get no weight. A day's ``fixed`` (map of weights by agent,
    if the column is there), where it has a positive sum, replaces the weights as it stands.
    Rewards: the return less costs and the squared position (legacy); less switching and changes of weights (profit_basic);
    less regret and switching (profit_regret); less switching and the drawdown (profit_light_risk).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mode = pdf["mode"].iloc[0]
        agents = sorted({a["agent"] for day in pdf["agents"] for a in day})
        place = {a: i for i, a in enumerate(agents)}
        before, pos, gross, peak, rows = np.zeros(len(agents)), 0.0, 1.0, 1.0, []
        for day in pdf.itertuples(index=False):
            ratio, ret, score = np.zeros(len(agents)), np.full(len(agents), np.nan), np.full(len(agents), np.nan)
            for a in day.agents:
                i = place[a["agent"]]
                ratio[i] = a["ratio"] or 0.0
                ret[i] = np.nan if a["ret"] is None else a["ret"]
                score[i] = np.nan if a["score"] is None else a["score"]
            free = [place[a] for a in agents if a not in excluded]
            kept = [place[a] for a in safe if a in place and a not in excluded]
            if day.regime_id == -1:
                own, source = kept, "regime_unknown"
            else:
                own, source = free if day.allowed is None else [place[a] for a in day.allowed if a in place and a not in excluded], "regime_topk"
            if not own:
                own, source = kept or free, "fallback_safe_set"
            if not own:
                raise ValueError("every agent is excluded")
            w = np.zeros(len(agents))
            w[own] = ema * raw_weights(score[own], beta, spread) + (1 - ema) * before[own]
            if w.sum() > 0:
                w = w / w.sum()
            else:
                w[own] = 1 / len(own)
            w = _capped(w, cap)
            fixed = np.zeros(len(agents))
            for a, x in dict(getattr(day, "fixed", None) or {}).items():
                if a in place:
                    fixed[place[a]] = x or 0.0
            if fixed.sum() > 0:
                w, source = fixed / fixed.sum(), "meta_router"
            new = smooth * float(np.clip(w @ ratio, -limit, limit)) + (1 - smooth) * pos
            turnover, moved = abs(new - pos), float(np.abs(w - before).sum())
            cost, held = cost_bps * 1e-4 * turnover, l2 * new * new
            got = max(new, 0.0) * (day.r_long or 0.0) + max(-new, 0.0) * (day.r_short or 0.0)
            best = float(np.nanmax(ret)) if np.isfinite(ret).any() else got
            gross *= 1 + got - cost - held
            peak = max(peak, gross)
            reward = got - cost - held
            if mode == "profit_basic":
                reward -= switch * turnover + churn * moved
            elif mode == "profit_regret":
                reward -= regret * max(0.0, best - got) + switch * turnover
            elif mode == "profit_light_risk":
                reward -= switch * turnover + drawdown * max(0.0, 1 - gross / max(peak, 1e-12))
            i = int(w.argmax())
            rows.append((mode, day.date, int(day.regime_id), source, new, turnover, cost, moved, got, best, reward, agents[i], float(w[i])))
            before, pos = w, new
        out = pd.DataFrame(rows, columns=["mode", "date", "regime_id", "allowed_source", "ratio", "turnover", "cost", "churn", "ret_selected", "ret_best", "reward", "selected", "weight"])
        return out.assign(equity=(1 + out["ret_selected"] - out["cost"]).cumprod())

    more = ["fixed"] if "fixed" in days.columns else []
    each = days.select("date", "regime_id", "r_long", "r_short", "allowed", "agents", *more, F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return each.groupBy("mode").applyInPandas(run, "mode string, date date, regime_id int, allowed_source string, ratio double, turnover double, cost double, churn double, ret_selected double, ret_best double, reward double, selected string, weight double, equity double")


def score_spread(edges: DataFrame, score: str = "ir_shrink") -> float:
    """Population deviation of all known scores; one number."""
    x = edges.where(F.col(score).isNotNull() & ~F.isnan(score)).agg(F.stddev_pop(score).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return float(x["s"]) if x["n"] > 1 else 1.0


def reward_mode_ranks(sim: DataFrame) -> DataFrame:
    """mode, equity_end, is_best: the mode that ends highest (of equals the first by name)."""
    ends = sim.groupBy("mode").agg(F.max_by("equity", "date").alias("equity_end"))
    best: Column = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("equity_end"), "mode")) == 1  # a row a mode
    return ends.withColumn("is_best", best)
