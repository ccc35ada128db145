"""Operators with state along a series. A series (one symbol, or one agent) is at most a few rows a day, so it is sorted in
one task; series are spread over the cluster. What can be a window is one; only true recursions run as grouped maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import by_symbol, ratio


#: Bound of the centroids that are broadcast.
MOST_CENTROIDS = 4096


def _extended(df: DataFrame, more: str) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{own}, {more}"


def ewm(df: DataFrame, spans: dict[str, float], x: str = "close") -> DataFrame:
    """Adds, for each name, the mean m += alpha * (x - m) from the first value on; ``spans``: name to alpha."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(**{n: pdf[x].ewm(alpha=a, adjust=False).mean() for n, a in spans.items()})

    return df.groupBy("symbol").applyInPandas(run, _extended(df, ", ".join(f"{n} double" for n in spans)))


def macd(df: DataFrame) -> DataFrame:
    """macd (12 and 26 rows), macd_signal (9 rows of it) and macd_cross: the histogram passes 0 upwards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        line = pdf["close"].ewm(span=12, adjust=False).mean() - pdf["close"].ewm(span=26, adjust=False).mean()
        return pdf.assign(macd=line, macd_signal=line.ewm(span=9, adjust=False).mean())

    df = df.groupBy("symbol").applyInPandas(run, _extended(df, "macd double, macd_signal double"))
    df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.withColumn("macd_cross", F.when((F.col("macd_hist") > 0) & (F.lag("macd_hist").over(by_symbol()) <= 0), 1).otherwise(0))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by means with alpha 1 / n; 50 where there is no loss yet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        d = pdf["close"].diff()
        gain, loss = (s.ewm(alpha=1 / n, adjust=False).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))
        return pdf.assign(rsi=(100 - 100 / (1 + gain / loss.replace(0.0, np.nan))).fillna(50.0))

    return df.groupBy("symbol").applyInPandas(run, _extended(df, "rsi double"))


def hold_counter(df: DataFrame, action: str, min_hold: int, by: str) -> DataFrame:
    """A row a series: its last action, the length of the run that it ends, and the rows that it must still be held."""
    w = Window.partitionBy(by).orderBy("date")
    new = F.when(F.col(action).eqNullSafe(F.lag(action).over(w)), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(by, "_run", action).agg(F.count(F.lit(1)).alias("held"))
    last = runs.groupBy(by).agg(F.max_by(F.struct(action, "held"), "_run").alias("x"))
    return last.select(by, f"x.{action}", "x.held", F.greatest(F.lit(min_hold) - F.col("x.held"), F.lit(0)).alias("must_hold"))


def min_hold(df: DataFrame, wanted: str, least: int, by: str) -> DataFrame:
    """Adds ``held``: the wanted label, but changed only once the one before has been held for ``least`` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out, now, since = [], None, least
        for x in pdf[wanted]:
            if now is None or (x != now and since >= least):
                now, since = x, 0
            since += 1
            out.append(now)
        return pdf.assign(held=out)

    return df.groupBy(by).applyInPandas(run, _extended(df, f"held {df.schema[wanted].dataType.simpleString()}"))


def daily_softmax(log: DataFrame, edges: DataFrame, beta: float = 2.0) -> DataFrame:
    """(date, regime_id, agent, ...) with ``raw_w``: softmax of beta * ir_shrink among the day's agents."""
    scored = log.join(edges.select("regime_id", "agent", "ir_shrink"), ["regime_id", "agent"])
    day = Window.partitionBy("date")
    top = F.exp(beta * (F.col("ir_shrink") - F.max("ir_shrink").over(day)))
    return scored.withColumn("_e", top).withColumn("raw_w", F.col("_e") / F.sum("_e").over(day)).drop("_e")


def weighted_simulation(log: DataFrame, weight: str, cost_bps: float = 10.0) -> DataFrame:
    """date, pos, turnover, cost, ret, equity of the day's weighted ratio (clipped to [-1, 1]) and weighted return."""
    days = log.groupBy("date").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col(weight) * F.col("ratio")))).alias("pos"), F.sum(F.col(weight) * F.col("ret")).alias("gross"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one book: a row a day
    days = days.withColumn("turnover", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    days = days.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("ret", F.col("gross") - F.col("cost"))
    return days.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("gross")


def soft_routing(scores: DataFrame, margin: float = 0.1, beta: float = 2.0) -> DataFrame:
    """(key columns, agents: array of struct(score, agent)) to ``hard``, ``second``, ``margin`` and ``weights``.

    The best agent alone if it leads by ``margin``; else the best two, shared by softmax.
    """
    ranked = scores.withColumn("_r", F.reverse(F.array_sort("agents")))
    first, second = F.col("_r")[0], F.get("_r", F.lit(1))
    gap = first["score"] - second["score"]
    share = 1 / (1 + F.exp(-beta * gap))
    two = F.map_from_arrays(F.array(first["agent"], second["agent"]), F.array(share, 1 - share))
    out = scores.withColumn("_r", F.reverse(F.array_sort("agents"))).withColumns({"hard": first["agent"], "second": second["agent"], "margin": gap})
    return out.withColumn("weights", F.when(second.isNull() | (gap >= margin), F.map_from_arrays(F.array(first["agent"]), F.array(F.lit(1.0)))).otherwise(two)).drop("_r")


def pair_environment(df: DataFrame, position: str, ret: str, by: str, bps: float = 10.0, l2: float = 0.01) -> DataFrame:
    """Adds reward: position * next return - cost of the position's change - l2 * position squared."""
    w = Window.partitionBy(by).orderBy("date")
    moved = F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0)))
    return df.withColumn("env_reward", F.col(position) * F.coalesce(F.lead(ret).over(w), F.lit(0.0)) - bps / 1e4 * moved - l2 * F.col(position) ** 2)


def expert_log(df: DataFrame, by: str = "agent", threshold: float = 0.15) -> DataFrame:
    """Adds logged (the reward announced a row before, 0 at first) and side: LONG, SHORT or CASH by the ratio."""
    w = Window.partitionBy(by).orderBy("date")
    side = F.when(F.col("ratio") > threshold, "LONG").when(F.col("ratio") < -threshold, "SHORT").otherwise("CASH")
    return df.withColumns({"logged": F.coalesce(F.lag("reward_next").over(w), F.lit(0.0)), "side": side})


def linear_policy(df: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """Adds action: tanh of the weighted sum, unknown or infinite inputs as 0, clipped to [-1, 1]."""
    def clean(c: str) -> Column:
        return F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))

    total = F.lit(bias)
    for c, x in weights.items():
        total = total + clean(c) * x
    return df.withColumn("action", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.tanh(total))))


def greedy_match(pairs: DataFrame, group: list[str], a: str, b: str, score: str, lag: str | None = None) -> DataFrame:
    """Within each group, pairs from the best score down, each a and b used once; ties by the smaller absolute ``lag``, then a, then b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, kept = set(), set(), []
        far = pdf[lag].abs() if lag else 0
        best = pdf.assign(_far=far).sort_values([score, "_far", a, b], ascending=[False, True, True, True])
        for i, x, y in zip(best.index, best[a], best[b], strict=True):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                kept.append(i)
        return pdf.loc[kept]

    return pairs.groupBy(*group).applyInPandas(run, pairs.schema)


def match_in_order(pairs: DataFrame, group: list[str], a: str, b: str, score: str) -> DataFrame:
    """Within each group, each a in turn takes its best b that none before it took; ties by b. An a without one gets no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, kept = set(), []
        for _, own in pdf.sort_values([a, score, b], ascending=[True, False, True]).groupby(a, sort=True):
            free = own[~own[b].isin(used)]
            if len(free):
                used.add(free[b].iloc[0])
                kept.append(free.index[0])
        return pdf.loc[kept]

    return pairs.groupBy(*group).applyInPandas(run, pairs.schema)


def lookback(df: DataFrame, columns: list[str], n: int, by: str = "symbol") -> DataFrame:
    """Adds window: the last n rows' columns, oldest first; only rows with n."""
    frame = Window.partitionBy(by).orderBy("date").rowsBetween(-(n - 1), 0)
    return df.withColumn("window", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame)).where(F.size("window") == n)


def last_rows(days: DataFrame, n: int) -> DataFrame:
    """date and last_days: the last n dates up to it, oldest first. A calendar's days are sorted in one task."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(n - 1), 0)
    return days.select("date", F.collect_list("date").over(w).alias("last_days"))


def anchor_to_target(df: DataFrame, horizons: tuple[int, ...], by: str = "symbol") -> DataFrame:
    """by, date, h, forecast: what was forecast h rows before for the date."""
    w = Window.partitionBy(by).orderBy("date")
    each = F.array(*[F.struct(F.lit(h).alias("h"), F.lag(f"pred_{h:02d}", h).over(w).alias("forecast")) for h in horizons])
    return df.select(by, "date", "close", each.alias("_e")).select(by, "date", "close", F.explode("_e").alias("e")).select(by, "date", "close", "e.h", "e.forecast").where("forecast is not null")


def nearest_centroid(df: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """The label of the nearest of few centroids (label, center: array), its distance d, and 1 / (1 + d).

    The centroids are broadcast as one row, so no more than MOST_CENTROIDS are taken.
    """
    if len(centroids.limit(MOST_CENTROIDS + 1).select("label").collect()) > MOST_CENTROIDS:  # as many labels at most
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    one = centroids.agg(F.collect_list(F.struct("label", "center")).alias("_c"))  # as many as there are labels
    near = df.crossJoin(F.broadcast(one))
    d2 = F.transform("_c", lambda c: F.struct(F.aggregate(F.zip_with(c["center"], F.col(vector), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x).alias("d2"), c["label"].alias("label")))
    best = F.array_min(d2)
    return near.withColumn("_b", best).withColumns({"nearest": F.col("_b.label"), "distance": F.sqrt("_b.d2")}).withColumn("confidence", 1 / (1 + F.col("distance"))).drop("_b", "_c")


def resample_linear(df: DataFrame, array: str, n: int) -> DataFrame:
    """The array at n evenly spaced places, by linear interpolation."""
    last = F.size(array) - 1

    def at(i: Column) -> Column:
        place = i * last / F.lit(max(n - 1, 1))
        low = F.floor(place).cast("int")
        a, b = F.get(array, low), F.get(array, F.least(low + 1, last))
        return a + (b - a) * (place - low)

    return df.withColumn("resampled", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def buy_and_hold(df: DataFrame, by: str = "symbol", x: str = "close") -> DataFrame:
    w = Window.partitionBy(by).orderBy("date")
    return df.withColumn("held", ratio(F.col(x), F.first(x).over(w)))
