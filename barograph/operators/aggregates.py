"""Aggregates over returns, regimes, agents and timings. ``ret`` is a period's return; order is always by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import ratio

YEAR = 252


def equity(ret: str, w: Window) -> Column:
    """Product of 1 + ret so far, for returns above -1."""
    return F.exp(F.sum(F.log1p(F.col(ret))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def with_drawdown(df: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """Adds equity and drawdown from the highest equity so far; the first equity is the first peak."""
    w = Window.partitionBy(*by).orderBy("date")
    df = df.withColumn("equity", equity(ret, w))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def return_metrics(df: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """n, mean, population deviation, Sharpe ratio a year, win rate, worst drawdown and equity multiple."""
    m = with_drawdown(df, by, ret).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("sd"), F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.min("drawdown").alias("max_dd"), F.max_by("equity", "date").alias("multiple"))
    return m.withColumn("sharpe", F.coalesce(ratio(F.col("mean"), F.col("sd")) * YEAR**0.5, F.lit(0.0)))


def split_metrics(df: DataFrame, by: list[str], price: str = "close") -> DataFrame:
    """Of a price: return in per cent from first to last, worst drawdown, Sharpe ratio (sample deviation), volatility and win rate of its changes."""
    w = Window.partitionBy(*by).orderBy("date")
    df = df.withColumns({"_r": ratio(F.col(price), F.lag(price).over(w)) - 1, "_dd": F.col(price) / F.max(price).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    m = df.groupBy(*by).agg(F.min_by(price, "date").alias("first"), F.max_by(price, "date").alias("last"), F.min("_dd").alias("max_dd"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("sd"), F.avg(F.when(F.col("_r") > 0, 1.0).when(F.col("_r").isNotNull(), 0.0)).alias("win_rate"))
    return m.select(*by, (100 * (F.col("last") / F.col("first") - 1)).alias("total_pct"), "max_dd", F.coalesce(ratio(F.col("mean"), F.col("sd")) * YEAR**0.5, F.lit(0.0)).alias("sharpe"), (F.col("sd") * YEAR**0.5).alias("volatility"), "win_rate")


def edge_table(log: DataFrame, k: float = 20.0) -> DataFrame:
    """(regime_id, agent, date, ret) to a row a regime and agent: EV, IR, both shrunk towards the agent's own by n / (n + k), quantiles."""
    own = log.groupBy("agent").agg(F.avg("ret").alias("ev_global"), F.coalesce(ratio(F.avg("ret"), F.stddev_pop("ret")), F.lit(0.0)).alias("ir_global"))
    cells = log.groupBy("regime_id", "agent").agg(F.count(F.lit(1)).alias("n_days"), F.avg("ret").alias("ev"), F.coalesce(ratio(F.avg("ret"), F.stddev_pop("ret")), F.lit(0.0)).alias("ir"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("p_win"), F.percentile("ret", 0.05).alias("q05"), F.percentile("ret", 0.95).alias("q95"))
    w = F.col("n_days") / (F.col("n_days") + k)
    out = cells.join(own, "agent").withColumn("w_shrink", w)
    return out.withColumns({"ev_shrink": w * F.col("ev") + (1 - w) * F.col("ev_global"), "ir_shrink": w * F.col("ir") + (1 - w) * F.col("ir_global")})


def profile(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Median, interquartile range and population deviation of each column."""
    quartiles = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    wide = df.groupBy(by).agg(*[quartiles(c).alias(f"q_{c}") for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns])
    return wide.select(by, *[x for c in columns for x in (F.col(f"q_{c}")[1].alias(f"median_{c}"), (F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]).alias(f"iqr_{c}"), F.col(f"sd_{c}"))])


def zscore_groups(df: DataFrame, column: str) -> DataFrame:
    """The column's z-score among the rows (groups); 0 where they do not differ. ``df`` has a row a group."""
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(f"z_{column}", F.when(F.col("_s") <= 1e-12, 0.0).otherwise(ratio(F.col(column) - F.col("_m"), F.col("_s")))).drop("_m", "_s")  # one row


def run_lengths(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Runs of equal labels by date: start, end and length."""
    w = Window.partitionBy(*by).orderBy("date")
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run", label).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def transitions(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Counts of label -> next label, and the share among what follows the label."""
    w = Window.partitionBy(*by).orderBy("date")
    pairs = df.withColumn("next", F.lead(label).over(w)).where("next is not null").groupBy(*by, F.col(label).alias("label"), "next").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "label")))


def transition_entropy(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Bits of what follows each label."""
    return transitions(df, label, by).groupBy(*by, "label").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def switch_rate(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Share of a label's rows whose next row has another; the last row counts as a switch."""
    w = Window.partitionBy(*by).orderBy("date")
    return df.withColumn("_s", F.when(F.lead(label).over(w) == F.col(label), 0.0).otherwise(1.0)).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("switch_rate"))


def modal_map(df: DataFrame, raw: str, stable: str) -> DataFrame:
    """The most frequent stable label of each raw one; the smallest of equals."""
    counts = df.groupBy(raw, stable).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(raw).agg(F.max_by(stable, F.struct("n", -F.col(stable))).alias(stable))


def scale_fit(df: DataFrame, x: str, y: str, days: int = 252, by: str = "symbol") -> DataFrame:
    """a = sd(y) / sd(x) and b = mean(y) - a * mean(x) over the last ``days`` calendar days."""
    ends = df.groupBy(by).agg(F.max("date").alias("_end"))
    tail = df.join(ends, by).where(F.col("date") > F.date_sub("_end", days)).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = tail.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ratio(F.stddev_samp(y), F.stddev_samp(x)).alias("a"), F.avg(y).alias("_y"), F.avg(x).alias("_x"))
    return fit.select(by, "n", "a", (F.col("_y") - F.col("a") * F.col("_x")).alias("b"))


def prediction_quality(df: DataFrame, pred: str, true: str, by: str) -> DataFrame:
    """n, coverage, MAE, correlation and OK, WARN or BAD."""
    m = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(pred).isNotNull() & F.col(true).isNotNull(), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.abs(F.col(pred) - F.col(true))).alias("mae"), F.corr(pred, true).alias("corr"))
    return m.withColumn("status", F.when((F.col("coverage") < 0.5) | F.col("corr").isNull(), "BAD").when((F.col("coverage") < 0.9) | (F.col("corr") < 0.1), "WARN").otherwise("OK"))


def pair_diversity(log: DataFrame, value: str = "ratio") -> DataFrame:
    """Every two agents on common dates: correlation, share of equal values. The number of agents is small and fixed."""
    a, b = (log.select("date", F.col("agent").alias(f"agent_{x}"), F.col(value).alias(x)) for x in "ab")
    both = a.join(b, "date").where("agent_a < agent_b")
    m = both.groupBy("agent_a", "agent_b").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("corr"), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("equal_rate"))
    return m.withColumn("status", F.when(F.col("corr").isNull(), "FLAT").when(F.col("corr") > 0.99, "SAME").otherwise("OK"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, sum, mean, min, p50, p95 and max."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("high"))


#: A profile's labels, in the order in which they are tried.
PANIC, RISING, FALLING, WILD_FALL, QUIET, REBOUND, UNCLEAR = "panic/volume spike", "上昇トレンド", "下降トレンド", "高ボラ下落", "低ボラ揉み合い", "深いDD後の反発初期", "mixed / unclear"
#: Columns of a profile: medians of these features.
PROFILE = ("ret_5", "ret_20", "ret_60", "ma_dev", "vol20", "dd20", "panic", "volume_z")


def profile_labels(profile: DataFrame) -> DataFrame:
    """Adds trend, vol, drawdown and panic scores from z-scores over the profiles (a row a label), their norm as ``separability``, and ``label``.

    ``profile``: the columns PROFILE. A feature that does not vary, or is unknown, scores 0.
    """
    one = Window.partitionBy(F.lit(0))  # a row for each of few labels
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(one)) / F.nullif(F.stddev_pop(c).over(one), F.lit(0.0)), F.lit(0.0))
    trend = z("ret_20") + z("ret_60") + z("ma_dev") - z("dd20") - 0.5 * z("vol20")
    scores = {"trend": trend, "vol": z("vol20") + 0.5 * z("volume_z"), "drawdown": -z("dd20"), "panic_score": z("panic") + 0.5 * z("volume_z")}
    out = profile.withColumns({k: F.round(v, 9) for k, v in scores.items()})
    norm = F.sqrt(sum((F.col(k) * F.col(k) for k in scores), F.lit(0.0)))
    t, v = F.col("trend"), F.col("vol")
    label = (
        F.when((F.col("panic_score") > 1) & (v > 0.75), PANIC).when((t > 1) & (v < 0.5), RISING).when((t < -1) & (v >= 0), FALLING).when((v > 1) & (F.col("ret_20") < 0), WILD_FALL)
        .when((v < -0.5) & (F.abs(t) < 0.75), QUIET).when((F.col("dd20") < -0.08) & (F.col("ret_5") > 0) & (t > 0), REBOUND).otherwise(UNCLEAR)
    )
    return out.withColumns({"separability": norm, "label": label})


def monthly_matches(df: DataFrame, label: str, columns: list[str], name: Column) -> DataFrame:
    """month, previous, current, distance, kept, kept_rate: each month's labels matched with the next month's, from the nearest
    medians on, each once; ``kept``: whether both have the same name (an aggregate of a label's rows over all months).

    The labels of two months are compared, all with all, so their number should be small; months spread.
    """
    from barograph.operators.sequential import greedy_match

    month = F.date_format("date", "yyyy-MM")
    m = df.groupBy(month.alias("month"), label).agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in columns])
    steps = m.select("month").distinct()
    steps = steps.withColumn("_next", F.lead("month").over(Window.partitionBy(F.lit(0)).orderBy("month"))).where("_next is not null")  # a row a month
    other = m.select(F.col("month").alias("_next"), F.col(label).alias("current"), *[F.col(f"m_{c}").alias(f"n_{c}") for c in columns])
    squares = sum((F.pow(F.col(f"m_{c}") - F.col(f"n_{c}"), F.lit(2)) for c in columns), F.lit(0.0))
    pairs = m.join(steps, "month").join(other, "_next").select("month", F.col(label).alias("previous"), "current", F.round(F.sqrt(squares), 6).alias("distance"))
    best = greedy_match(pairs.withColumn("_near", -F.col("distance")), ["month"], "previous", "current", "_near").drop("_near")
    names = df.groupBy(label).agg(name.alias("_name"))
    of = lambda c: names.select(F.col(label).alias(c), F.col("_name").alias(f"_{c}"))
    out = best.join(of("previous"), "previous").join(of("current"), "current").withColumn("kept", F.col("_previous") == F.col("_current"))
    rate = F.avg(F.col("kept").cast("double")).over(Window.partitionBy("month"))
    return out.select("month", "previous", "current", "distance", "kept", rate.alias("kept_rate"))


def data_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: rows, nulls, least and greatest value, from one pass."""
    one = df.agg(*[x for c in columns for x in (F.count(F.lit(1)).alias(f"n_{c}"), F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(f"k_{c}"), F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"b_{c}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"k_{c}").alias("n_null"), F.col(f"a_{c}").alias("low"), F.col(f"b_{c}").alias("high")) for c in columns])).alias("x")).select("x.*")


def frequencies(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of all rows."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


def bootstrap(days: DataFrame, label: str, samples: int = 20, seed: int = 1) -> DataFrame:
    """label, occupancy_mean, occupancy_std, bootstrap_stability, co_membership_stability over seeded resamples of the days.

    A day counts a hash-drawn Poisson number of times in a resample. Co-membership: the share of a label's rows whose row
    before, in order of date within the resample, has the same label; a day's further copies follow its first.
    """
    u = (F.pmod(F.xxhash64("date", "b", F.lit(seed)), F.lit(1_000_000)) + 0.5) / 1_000_000
    times = sum((F.when(u > edge, 1).otherwise(0) for edge in (0.3679, 0.7358, 0.9197, 0.9810, 0.9963)), F.lit(0))  # of a Poisson(1)
    rows = days.select("date", F.col(label).alias("label"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b")).withColumn("n", times).where("n > 0")
    w = Window.partitionBy("b").orderBy("date")
    rows = rows.withColumn("same", F.col("n") - 1 + F.when(F.col("label") == F.lag("label").over(w), 1).otherwise(0))
    each = rows.groupBy("b", "label").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    each = each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("b")))
    # A label that a resample lacks has a share of 0 there.
    known = each.groupBy("label").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("ss"), F.avg(F.col("same") / F.col("n")).alias("co_membership_stability"))
    mean = F.col("s") / samples
    sd = F.sqrt(F.greatest(F.col("ss") / samples - mean * mean, F.lit(0.0)))
    return known.select(F.col("label").alias(label), mean.alias("occupancy_mean"), sd.alias("occupancy_std"), (1 / (1 + sd)).alias("bootstrap_stability"), "co_membership_stability")


def robust_pca(df: DataFrame, columns: list[str], k: int, by: str = "symbol") -> DataFrame:
    """Adds pc_1 to pc_k: the columns less their median, by their interquartile range, on the main axes of their covariance.

    One aggregate gives the covariance (as many numbers as there are pairs of columns); its axes are worked out on the
    driver. An axis points to where its largest part is above 0. A column that does not vary counts by 1.
    """
    import numpy as np

    quartiles = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
    if quartiles is None or any(quartiles[c] is None for c in columns):
        return df.withColumns({f"pc_{i + 1}": F.lit(None).cast("double") for i in range(k)})
    scaled = {c: (F.col(c) - quartiles[c][1]) / (quartiles[c][2] - quartiles[c][0] or 1.0) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.avg(scaled[c]).alias(f"m_{c}") for c in columns], *[F.covar_pop(scaled[a], scaled[b]).alias(f"v_{a}_{b}") for a, b in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = one[f"v_{a}_{b}"]
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    out = {}
    for n, axis in enumerate(axes, 1):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        total = F.lit(0.0)
        for c, x in zip(columns, axis.tolist(), strict=True):
            total = total + (scaled[c] - one[f"m_{c}"]) * x
        out[f"pc_{n}"] = total
    return df.withColumns(out)


def scaler_fit(train: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Mean and population deviation (1 where it is 0), least and greatest, of the training rows alone."""
    return train.groupBy(by).agg(*[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0).alias(f"sd_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])
