"""Technical features of bars (symbol, date, open, high, low, close, volume). All look back only, unless named forward.

Each function adds columns and keeps the others. Rows are keyed by (symbol, date); nulls in prices make the features
that use them null, except where a fill is named.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import by_symbol, change, fill_forward, ratio, roll


def gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", F.coalesce(ratio(F.col("open"), F.lag("close").over(by_symbol())) - 1, F.lit(0.0)))


def true_range() -> Column:
    last = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def atr_norm(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("tr", true_range())
    return df.withColumn("atr_norm", F.coalesce(ratio(roll(F.avg, "tr", n, n), F.lag("close").over(by_symbol())), F.lit(0.0)))


def returns(df: DataFrame, ks: tuple[int, ...] = (1, 5, 20, 60, 252, 2016)) -> DataFrame:
    """Changes over k rows; a missing close counts as the one before."""
    df = df.withColumn("_known", fill_forward("close"))
    return df.withColumns({f"ret_{k}": change("_known", k) for k in ks}).drop("_known")


def volume(df: DataFrame) -> DataFrame:
    mean, sd = roll(F.avg, "volume", 20, 1), roll(F.stddev_samp, "volume", 20, 1)
    return df.withColumns({"rvol20": F.coalesce(ratio(F.col("volume"), mean), F.lit(1.0)), "volz20": F.coalesce(ratio(F.col("volume") - mean, sd), F.lit(0.0))})


def volume_flags(df: DataFrame) -> DataFrame:
    df = volume(df).withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    more = F.col("rvol20") - F.lag("rvol20").over(by_symbol())
    return df.withColumns({
        "div_down_vol_up": F.when((F.col("r") < 0) & (F.col("rvol20") > 1), 1).otherwise(0),
        "energy_fade": F.when((F.col("r") > 0) & (more < 0), 1).otherwise(0),
        "panic": F.greatest(-F.col("r"), F.lit(0.0)) * F.greatest("volz20", F.lit(0.0)),
    })


#: Columns of the nested observation profiles, where a table has them.
_BASE, _PRICE, _EXTRA = ("gap", "atr_norm"), ("oc_ret", "ret_1", "ret_5", "ret_20", "body_ratio", "range_atr", "vol_log_ratio"), ("rsi", "macd_hist", "dev_z", "dev_score", "volz20")
_LABELS, _RAW = ("label", "available", "target", "y_"), ("open", "high", "low", "close", "volume")


#: Columns of a profile besides a table's own embeddings; D takes every number that is no label, not of the next day and no raw price.
PROFILES = {"A": _BASE, "B": (*_BASE, *_PRICE), "C": (*_BASE, *_PRICE, *_EXTRA), "D": None}
_NUMBERS = {"double", "float", "int", "bigint", "smallint", "tinyint"}


def observation_columns(df: DataFrame, profile: str, prefix: str) -> list[str]:
    """The columns of a profile that the table has, after those that begin with ``prefix``."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    kinds = dict(df.dtypes)
    wanted = PROFILES[profile]
    if wanted is None:
        hidden = (*_LABELS, "_next")
        wanted = [c for c in kinds if kinds[c] in _NUMBERS and c not in _RAW and not any(word in c.lower() for word in hidden)]
    own = [c for c in kinds if c.startswith(prefix)]
    return own + [c for c in wanted if c in kinds and c not in own]


def candle(df: DataFrame) -> DataFrame:
    df = df.withColumns({"tr": true_range()}).withColumn("atr", roll(F.avg, "tr", 14, 14))
    span, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    return df.withColumns({
        "range_atr": ratio(span, F.col("atr")),
        "body_atr": ratio(body, F.col("atr")),
        "body_ratio": ratio(body, span),
        "upper_wick": ratio(F.col("high") - F.greatest("open", "close"), span),
        "lower_wick": ratio(F.least("open", "close") - F.col("low"), span),
        "clv": ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), span),
    }).drop("tr", "atr")


def volume_log_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_log_ratio", F.log(F.nullif(F.col("volume"), F.lit(0.0))) - F.log(F.nullif(roll(F.avg, "volume", 20, 20), F.lit(0.0))))


def deviation(df: DataFrame, n: int = 25) -> DataFrame:
    z = ratio(F.col("close") - roll(F.avg, "close", n, n), roll(F.stddev_pop, "close", n, n))
    df = df.withColumn("dev_z", z)
    return df.withColumn("dev_score", F.col("dev_z") * F.lag("dev_z").over(by_symbol()))


def distribution_days(df: DataFrame) -> DataFrame:
    falls = (F.col("close") < F.lag("close").over(by_symbol())) & (F.col("volume") > F.lag("volume").over(by_symbol()))
    rises = (F.col("close") >= F.lag("close").over(by_symbol())) & (F.col("volume") > F.lag("volume").over(by_symbol()))
    df = df.withColumns({"distribution": F.when(falls, 1).otherwise(0), "absorption": F.when(rises, 1).otherwise(0)})
    return df.withColumn("dist_25", roll(F.sum, "distribution", 25, 1))


def money_flow(df: DataFrame, n: int = 20) -> DataFrame:
    weight = ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    df = df.withColumn("_flow", weight * F.col("volume"))
    return df.withColumn("cmf", ratio(roll(F.sum, "_flow", n, n), roll(F.sum, "volume", n, n))).drop("_flow")


def context(df: DataFrame) -> DataFrame:
    df = df.withColumn("r1", change("close"))
    trend = {f"trend_{n}": ratio(F.col("close"), roll(F.avg, "close", n, m)) - 1 for n, m in ((20, 5), (63, 10), (252, 20))}
    vol = {f"vol_{n}": roll(F.stddev_pop, "r1", n, m) for n, m in ((20, 5), (63, 10), (252, 20))}
    # A day without volume is an unknown one.
    traded = F.nullif(F.col("volume"), F.lit(0.0))
    turnover = {f"turnover_{n}": ratio(traded, roll(F.avg, traded, n, m)) - 1 for n, m in ((20, 5), (63, 10))}
    long = {"long_ret_252": change("close", 252), "long_ret_2016": change("close", 2016)}
    out = df.withColumns({**vol, **trend, **turnover, **long, "dd_252": ratio(F.col("close"), roll(F.max, "close", 252, 20)) - 1}).drop("r1")
    return out.fillna(0.0, [*vol, *trend, *turnover, *long, "dd_252"])


#: Columns that may stand for a price or a volume, the best first.
CLOSES, VOLUMES = ("close_anchor", "close", "adj_close"), ("volume", "rvol20", "vol_log_ratio")


def source_diagnostics(df: DataFrame) -> DataFrame:
    """One row: which columns context features would be made from, whether the volume is a stand-in, and what is missing."""
    first = lambda names: next((c for c in names if c in df.columns), None)
    close, volume_ = first(CLOSES), first(VOLUMES)
    missing = [c for c in ("gap_atr", "atr_norm", "ret_20") if c not in df.columns]
    return df.sparkSession.createDataFrame([(close, volume_, volume_ is not None and volume_ != "volume", "|".join(missing))], "close_source string, volume_source string, is_proxy boolean, missing string")


def cluster_signal(df: DataFrame, x: str = "close") -> DataFrame:
    return df.withColumns({"sig_20d": roll(F.avg, x, 20, 1), "sig_8w": roll(F.avg, x, 40, 1), "sig_6m": roll(F.avg, x, 126, 1)})


def long_context(df: DataFrame, n: int = 2016, least: int = 50) -> DataFrame:
    hi, lo = roll(F.max, "close", n, least), roll(F.min, "close", n, least)
    high, low = ratio(hi - F.col("close"), hi - lo), ratio(F.col("close") - lo, hi - lo)
    return df.withColumns({"range_pos": low, "high_distance": high, "low_distance": low, "from_high": ratio(F.col("close"), hi) - 1, "from_low": ratio(F.col("close"), lo) - 1})


def rolling_rank(df: DataFrame, columns: dict[str, str], n: int = 2016, least: int = 50) -> DataFrame:
    """For each new name, the share of the last n known values of the column that rank at or below the current one, ties averaged.

    ``columns``: new name to column. Long windows, so ranks come from a grouped map over each symbol with an ordered window.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(**{new: pdf[old].rolling(n, min_periods=least).rank(pct=True) for new, old in columns.items()})

    fields = "".join(f", `{c}` double" for c in columns)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy("symbol").applyInPandas(run, own + fields)


def evaluation(df: DataFrame) -> DataFrame:
    df = df.withColumns({"r1": change("close"), "ma20": roll(F.avg, "close", 20, 5)})
    return df.withColumns({
        "ma_dev": ratio(F.col("close"), F.col("ma20")) - 1,
        "ma_slope": ratio(F.col("ma20"), F.lag("ma20", 5).over(by_symbol())) - 1,
        "vol20": roll(F.stddev_pop, "r1", 20, 5) * 252**0.5,
        "dd20": ratio(F.col("close"), roll(F.max, "close", 20, 1)) - 1,
        "dd60": ratio(F.col("close"), roll(F.max, "close", 60, 1)) - 1,
        "volume_z": ratio(F.col("volume") - roll(F.avg, "volume", 20, 5), roll(F.stddev_pop, "volume", 20, 5)),
    }).drop("r1", "ma20")


def forward(df: DataFrame) -> DataFrame:
    """Not causal: labels. Next and fifth next change, deviation a year of the five changes from the fourth row ahead back,
    and the least change to any of the next five closes.

    The changes are shifted four rows before they are rolled, so the deviation has no rows before the symbol's first.
    """
    worst = F.min("close").over(by_symbol().rowsBetween(1, 5))
    df = df.withColumn("_ahead", F.lead(change("close"), 4).over(by_symbol()))
    vol = roll(F.stddev_pop, "_ahead", 5, 3) * 252**0.5
    df = df.withColumn("fwd_vol_5", vol).drop("_ahead")
    return df.withColumns({"fwd_1": ratio(F.lead("close").over(by_symbol()), F.col("close")) - 1, "fwd_5": ratio(F.lead("close", 5).over(by_symbol()), F.col("close")) - 1, "fwd_min_5": ratio(worst, F.col("close")) - 1})


def next_return(df: DataFrame) -> DataFrame:
    return df.withColumn("next_ret", F.coalesce(ratio(F.lead("close").over(by_symbol()), F.col("close")) - 1, F.lit(0.0)))


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a next one, and the change to it."""
    df = df.withColumns({"delta": F.lead("close").over(by_symbol()) - F.col("close"), "label_ret": ratio(F.lead("close").over(by_symbol()), F.col("close")) - 1})
    return df.where("delta is not null")


def observed(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """The columns as they were one row before."""
    return df.withColumns({c: F.lag(c).over(by_symbol()) for c in columns})


def zscore(df: DataFrame, x: str = "close", n: int = 20) -> DataFrame:
    return df.withColumn("z", ratio(F.col(x) - roll(F.avg, x, n, n), roll(F.stddev_pop, x, n, n)))


def previous_features(df: DataFrame) -> DataFrame:
    """Features of the row before: its change, and its close's deviation over 20 rows."""
    df = df.withColumn("prev_close", F.lag("close").over(by_symbol()))
    df = df.withColumns({"prev_ret": change("prev_close")})
    return df.withColumn("prev_z", ratio(F.col("prev_close") - roll(F.avg, "prev_close", 20, 20), roll(F.stddev_pop, "prev_close", 20, 20)))


def week_index(df: DataFrame) -> DataFrame:
    """The row's number within its week from Monday, from 0."""
    week = Window.partitionBy("symbol", F.date_trunc("week", "date")).orderBy("date")
    return df.withColumn("week_index", F.row_number().over(week) - 1)


def envelope(df: DataFrame, n: int = 20) -> DataFrame:
    """Place within the last n closes' range, rows between their highest and lowest (the first of equals), and the angle."""
    frame = by_symbol().rowsBetween(-(n - 1), 0)
    df = df.withColumn("_all", F.collect_list("close").over(frame))
    top, bottom = F.array_max("_all"), F.array_min("_all")
    rows = (F.array_position("_all", top) - F.array_position("_all", bottom)).cast("long")
    return df.withColumns({"env_pos": ratio(F.col("close") - bottom, top - bottom), "env_rows": rows, "env_angle": F.degrees(F.atan2(top - bottom, rows.cast("double"))), "env_hypot": F.hypot(top - bottom, rows.cast("double"))}).drop("_all")


def log_return_regime(df: DataFrame, bins: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """Volatility and trend of log returns over 20 rows in three bins each by the symbol's quantiles, and 3 * trend + volatility."""
    df = df.withColumn("_lr", F.log(ratio(F.col("close"), F.lag("close").over(by_symbol()))))
    df = df.withColumns({"lr_vol": roll(F.stddev_samp, "_lr", 20, 5), "lr_mean": roll(F.avg, "_lr", 20, 5)})
    cuts = df.groupBy("symbol").agg(*[F.percentile(c, F.array(*map(F.lit, bins))).alias(f"_{c}") for c in ("lr_vol", "lr_mean")])
    df = df.join(cuts, "symbol")
    bin_of = lambda c: F.when(F.col(c).isNull(), 1).when(F.col(c) <= F.col(f"_{c}")[0], 0).when(F.col(c) <= F.col(f"_{c}")[1], 1).otherwise(2)
    df = df.withColumns({"vol_bin": bin_of("lr_vol"), "trend_bin": bin_of("lr_mean")})
    return df.withColumn("phase", 3 * F.col("trend_bin") + F.col("vol_bin")).drop("_lr", "_lr_vol", "_lr_mean")
