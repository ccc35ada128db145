"""Summaries of timings over sets of groups, from mergeable quantile sketches stored by day, made exact by a second pass.

A sketch (KLL, a few KB) bounds where a group's percentile lies; the second pass counts the rows below and ranks only those
inside, by range partitions. So no task holds a group, whatever its size, and days that are stored already are not read
again for sums and bounds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.operators.positions import positions
from barograph.sources.tables import materialize

PROBABILITIES = (0.5, 0.95)
#: Half the width, in rank, of the interval that the second pass looks at; a sketch of K values errs by 0.0165 at most in 99 of 100 cases.
K, MARGIN = 200, 0.035
#: Buffer before a start: a share of the 95th percentile, and a least number of seconds.
BUFFER_SHARE, LEAST_BUFFER = 0.2, 60.0


def known(value: str) -> Column:
    return F.when(~F.isnan(value), F.col(value)).cast("double")


def daily_sketches(df: DataFrame, day: Column, dims: list[str], value: str) -> DataFrame:
    """day, dims, n, total, low, high, sketch: what is stored of each day. Null and NaN values do not count."""
    x = known(value)
    return df.groupBy(day.alias("day"), *dims).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, K).alias("sketch"))


def merged(sketches: DataFrame, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """set_id, dims, n, total, mean, low, high, sketch of each group of each set, over all days. ``set_id``: grouping_id of ``dims``."""
    out = sketches.groupingSets(sets, *dims).agg(F.grouping_id().alias("set_id"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", K).alias("sketch"))
    return out.select("set_id", *dims, "n", "total", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "low", "high", "sketch")


def _spread(df: DataFrame, dims: list[str], sets: list[list[str]], value: str) -> DataFrame:
    """Each known value once for each set, with the dims that are not in the set null."""
    each = []
    for own in sets:
        number = sum((d not in own) << (len(dims) - 1 - i) for i, d in enumerate(dims))
        each.append(F.struct(F.lit(number).cast("long").alias("set_id"), *[(F.col(d) if d in own else F.lit(None).cast(df.schema[d].dataType)).alias(d) for d in dims]))
    return df.select(F.explode(F.array(*each)).alias("g"), known(value).alias("x")).where("x is not null").select("g.*", "x")


def percentiles(df: DataFrame, day: Column, dims: list[str], sets: list[list[str]], value: str, sketches: DataFrame | None = None) -> DataFrame:
    """``merged`` with exact p50 and p95 (linear between neighbours) in place of the sketch.

    ``sketches``: those of ``daily_sketches``, if they are stored; they must cover ``df``.
    """
    stored = materialize(daily_sketches(df, day, dims, value), "daily-sketches") if sketches is None else sketches
    groups = materialize(merged(stored, dims, sets).withColumn("_id", F.monotonically_increasing_id()), "timing-groups")
    wanted = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, p - MARGIN))).alias("lo"), F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, p + MARGIN))).alias("hi")) for p in PROBABILITIES]
    aims = groups.where("n > 0").select("_id", "set_id", *dims, "n", "low", "high", F.explode(F.array(*wanted)).alias("w")).select("_id", "set_id", *dims, "n", "low", "high", "w.*")
    values = _spread(df, dims, sets, value)
    found = None
    # The second round is for groups whose sketch was off: all of their values are inside.
    for last in (False, True):
        ranked, missed = _ranked(values, aims, dims)
        found = ranked if found is None else found.unionByName(ranked)
        if last or missed.isEmpty():
            break
        aims = missed.withColumns({"lo": F.col("low"), "hi": F.col("high")})
    wide = found.groupBy("_id").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(100 * p)}") for p in PROBABILITIES])
    out = groups.drop("sketch").join(wide, "_id", "left")
    return out.select("set_id", *dims, "n", "total", "mean", "low", "high", *[f"p{round(100 * p)}" for p in PROBABILITIES])


def _ranked(values: DataFrame, aims: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """(_id, p, q) of the aims whose percentile lies between lo and hi, and the aims for which it does not."""
    same = values["set_id"] == aims["set_id"]
    for d in dims:
        same &= values[d].eqNullSafe(aims[d])
    joined = values.join(aims, same).select("_id", "p", "lo", "hi", "x")
    counts = materialize(joined.groupBy("_id", "p").agg(F.count(F.when(F.col("x") < F.col("lo"), 1)).alias("below"), F.count(F.when(F.col("x").between(F.col("lo"), F.col("hi")), 1)).alias("inside")), "timing-counts")
    place = F.col("p") * (F.col("n") - 1)
    first = F.floor(place).cast("long")
    told = aims.join(counts, ["_id", "p"]).withColumns({"first": first, "share": place - first})
    fits = (F.col("below") <= F.col("first")) & (F.least(F.col("first") + 1, F.col("n") - 1) < F.col("below") + F.col("inside"))
    inside = positions(joined.where(F.col("x").between(F.col("lo"), F.col("hi"))).select("_id", "p", "x"), ["x"], ["_id", "p"], position="at")
    ends = told.where(fits).select("_id", "p", "first", "share", "below", "n")
    near = inside.join(ends, ["_id", "p"]).withColumn("rank", F.col("below") + F.col("at")).where((F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("first") + 1))
    low, high = F.min("x"), F.max("x")
    ranked = near.groupBy("_id", "p").agg(F.first("share").alias("share"), low.alias("a"), high.alias("b")).select("_id", "p", (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("q"))
    return ranked, told.where(~fits).select(*aims.columns)


def start_budget(summary: DataFrame) -> DataFrame:
    """Adds buffer and start_offset: how long before a deadline to begin, from p95."""
    buffer = F.greatest(F.lit(LEAST_BUFFER), F.ceil(BUFFER_SHARE * F.col("p95")).cast("double"))
    return summary.withColumns({"buffer": buffer, "start_offset": F.col("p95") + buffer})


def all_sets(dims: list[str]) -> list[list[str]]:
    """Every subset, as a cube has them."""
    return [list(c) for n in range(len(dims), -1, -1) for c in itertools.combinations(dims, n)]
