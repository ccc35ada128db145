"""Invariants as queries: a row for each check with what it measured and whether it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import ratio
from barograph.operators.aggregates import with_drawdown


def reward_alignment(log: DataFrame, by: str = "agent", logged: str = "logged", tolerance: float = 1e-12, equity: str | None = None, equity_tolerance: float = 1e-10) -> DataFrame:
    """by, max_error, worst_date, ok: the logged return must be the reward announced a row before; with ``equity`` also
    equity_error: the largest relative distance of that column from the growth that the logged returns make, from its first value on."""
    w = Window.partitionBy(by).orderBy("date")
    log = log.withColumn("_e", F.abs(F.col(logged) - F.lag("reward_next").over(w)))
    if equity:
        grown = F.exp(F.sum(F.log1p(logged)).over(w))
        log = log.withColumn("_g", grown)
        log = log.withColumn("_g", F.col("_g") * F.first(equity).over(w) / F.first("_g").over(w))
        log = log.withColumn("_q", F.abs(F.col("_g") - F.col(equity)) / F.greatest(F.abs("_g"), F.abs(equity), F.lit(1e-12)))
    known = F.col("_e").isNotNull()
    m = log.groupBy(by).agg(F.max("_e").alias("max_error"), F.max_by("date", F.when(known, F.struct(F.round("_e", 12), "date"))).alias("worst_date"), *([F.max("_q").alias("equity_error")] if equity else []), F.max(known).alias("_any")).where("_any").drop("_any")
    ok = F.col("max_error") <= tolerance
    return m.withColumn("ok", ok & (F.col("equity_error") <= equity_tolerance) if equity else ok)


def market_alignment(log: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Per agent: the return must be the position's share of the long or the short market's, less the cost."""
    error = F.abs(F.col("ret") - (F.greatest("ratio", F.lit(0.0)) * F.col("r_long") + F.greatest(-F.col("ratio"), F.lit(0.0)) * F.col("r_short") - F.col("cost")))
    return log.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max(error).alias("max_error"), F.sum(F.when(error > tolerance, 1).otherwise(0)).cast("long").alias("n_off"))


def lag_hypotheses(log: DataFrame, position: str, ret: str, target: str, by: str, lags: tuple[int, ...] = (-2, -1, 0, 1, 2, 3)) -> DataFrame:
    """by, k, n, mae, corr, equity_end, max_dd, rank: how well position k rows before times the return explains the target, and what it would have earned."""
    w = Window.partitionBy(by).orderBy("date")
    each = F.array(*[F.struct(F.lit(k).alias("k"), (F.lag(position, k).over(w) * F.col(ret)).alias("guess")) for k in lags])
    long = log.select(by, "date", F.col(target).alias("_t"), each.alias("_e")).select(by, "date", "_t", F.explode("_e").alias("e")).select(by, "date", "_t", "e.k", "e.guess").where("guess is not null")
    long = with_drawdown(long, [by, "k"], "guess")
    m = long.groupBy(by, "k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("_t") - F.col("guess"))).alias("mae"), F.corr("_t", "guess").alias("corr"), F.max_by("equity", "date").alias("equity_end"), F.min("drawdown").alias("max_dd"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.round("mae", 12), "k")))


def implied_returns(log: DataFrame, by: str = "symbol") -> DataFrame:
    """by, implied, definition, n, mae, rmse, corr, rank: the return that a log's ret implies, by its own position or that of the row before,
    with or without the cost, against the change from open to close and from close to close, of the row and of the next.

    ``log``: by, date, open, close, pos, ret, cost. A position of 0 implies nothing. The best rank has the highest correlation, then the smaller errors.
    """
    w = Window.partitionBy(by).orderBy("date")
    before = F.lag("pos").over(w)
    least = lambda p: F.when(F.abs(p) > 1e-12, p)
    implied = {"own": F.col("ret") / least(F.col("pos")), "own_cost": (F.col("ret") + F.col("cost")) / least(F.col("pos")), "before": F.col("ret") / least(before), "before_cost": (F.col("ret") + F.col("cost")) / least(before)}
    o, c, no, nc = F.col("open"), F.col("close"), F.lead("open").over(w), F.lead("close").over(w)
    real = {"oc_same": ratio(c, o) - 1, "cc_same": ratio(c, F.lag("close").over(w)) - 1, "oc_next": ratio(nc, no) - 1, "cc_next": ratio(nc, c) - 1}
    listed = lambda kinds, name: F.array(*[F.struct(F.lit(k).alias(name), v.alias("v")) for k, v in kinds.items()])
    long = log.select(by, listed(implied, "implied").alias("i"), listed(real, "definition").alias("d")).select(by, F.explode("i").alias("i"), "d").select(by, "i", F.explode("d").alias("d"))
    e = F.col("i.v") - F.col("d.v")
    m = long.groupBy(by, F.col("i.implied").alias("implied"), F.col("d.definition").alias("definition")).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("i.v", "d.v").alias("corr"))
    order = Window.partitionBy(by).orderBy(F.round(F.coalesce("corr", F.lit(-1.0)), 6).desc(), F.round("rmse", 6), F.round("mae", 6), F.desc("n"), "implied", "definition")
    return m.withColumn("rank", F.row_number().over(order))


def no_backfill(df: DataFrame, column: str, warm_up: int, by: str = "symbol") -> DataFrame:
    """by, n_known, ok: within the first ``warm_up`` rows the column must be unknown."""
    w = Window.partitionBy(by).orderBy("date")
    early = df.select(by, column, F.row_number().over(w).alias("_n")).where(F.col("_n") <= warm_up)
    return early.groupBy(by).agg(F.count(column).alias("n_known")).withColumn("ok", F.col("n_known") == 0)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, if it has the columns; a KeyError before any work if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def roll_up(levels: DataFrame) -> DataFrame:
    """(section, status) to the worst status of each section: BAD, then WARN or SKIP, then OK."""
    level = F.when(F.col("status") == "BAD", 2).when(F.col("status").isin("WARN", "SKIP"), 1).otherwise(0)
    worst = levels.groupBy("section").agg(F.max(level).alias("_l"))
    return worst.select("section", F.when(F.col("_l") == 2, "BAD").when(F.col("_l") == 1, "WARN").otherwise("OK").alias("status"))
