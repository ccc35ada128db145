"""Windows over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.windows import centered
from barograph.operators import features as ft
from barograph.operators import sequential as sq
from barograph.plans.registry import W, over, query, r, rounded
from barograph.sources.bars import bars

KEY = ["symbol", "date"]
TR = f"greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W}))"
RET = f"(close / nullif(lag(close) OVER {W}, 0) - 1)"


def _out(df: DataFrame, *columns: str, exact: tuple[str, ...] = ()) -> DataFrame:
    return rounded(df.select(*KEY, *columns, *exact), *columns)


@query(f"SELECT symbol, date, {r('gap')} FROM (SELECT *, coalesce(open / nullif(lag(close) OVER {W}, 0) - 1, 0) AS gap FROM bars)")
def win_gap(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.gap(bars(spark, d)), "gap")


@query(f"SELECT symbol, date, {r('tr', 'atr_norm')} FROM (SELECT *, coalesce({over('avg', 'tr', 14, 14)} / nullif(lag(close) OVER {W}, 0), 0) AS atr_norm FROM (SELECT *, {TR} AS tr FROM bars))")
def win_atr_norm(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.atr_norm(bars(spark, d)), "tr", "atr_norm")


_KS = (1, 5, 20, 60, 252, 2016)


@query("SELECT symbol, date, " + ", ".join(f"round(close / nullif(lag(close, {k}) OVER {W}, 0) - 1, 6) + 0.0 AS ret_{k}" for k in _KS) + " FROM bars")
def win_ret_k(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.returns(bars(spark, d), _KS), *[f"ret_{k}" for k in _KS])


_VOL = f"""v AS (SELECT *, coalesce(volume / nullif({over('avg', 'volume', 20, 1)}, 0), 1) AS rvol20,
  coalesce((volume - {over('avg', 'volume', 20, 1)}) / nullif({over('stddev_samp', 'volume', 20, 1)}, 0), 0) AS volz20, coalesce({RET}, 0) AS r FROM bars)"""


@query(f"SELECT symbol, date, {r('rvol20', 'volz20')} FROM v", more=_VOL)
def win_volume_bnf(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.volume(bars(spark, d)), "rvol20", "volz20")


@query(f"""SELECT symbol, date, {r('panic')}, CAST(CASE WHEN r < 0 AND round(rvol20, 9) > 1 THEN 1 ELSE 0 END AS INTEGER) AS div_down_vol_up,
  CAST(CASE WHEN r > 0 AND round(rvol20 - lag(rvol20) OVER {W}, 9) < 0 THEN 1 ELSE 0 END AS INTEGER) AS energy_fade FROM (SELECT *, greatest(-r, 0) * greatest(volz20, 0) AS panic FROM v)""", more=_VOL)
def win_bnf_flags(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.volume_flags(bars(spark, d)), "panic", exact=("div_down_vol_up", "energy_fade"))


_CANDLE = ["range_atr", "body_atr", "body_ratio", "upper_wick", "lower_wick", "clv"]


@query(f"""SELECT symbol, date, {r(*_CANDLE)} FROM (SELECT symbol, date, (high - low) / nullif(atr, 0) AS range_atr, abs(close - open) / nullif(atr, 0) AS body_atr,
  abs(close - open) / nullif(high - low, 0) AS body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick, (least(open, close) - low) / nullif(high - low, 0) AS lower_wick,
  ((close - low) - (high - close)) / nullif(high - low, 0) AS clv FROM (SELECT *, {over('avg', 'tr', 14, 14)} AS atr FROM (SELECT *, {TR} AS tr FROM bars)))""")
def win_candle(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.candle(bars(spark, d)), *_CANDLE)


@query(f"SELECT symbol, date, {r('vol_log_ratio')} FROM (SELECT *, ln(nullif(volume, 0)) - ln(nullif({over('avg', 'volume', 20, 20)}, 0)) AS vol_log_ratio FROM bars)")
def win_vol_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.volume_log_ratio(bars(spark, d)), "vol_log_ratio")


@query(f"SELECT symbol, date, {r('dev_z', 'dev_score')} FROM (SELECT *, dev_z * lag(dev_z) OVER {W} AS dev_score FROM (SELECT *, (close - {over('avg', 'close', 25, 25)}) / nullif({over('stddev_pop', 'close', 25, 25)}, 0) AS dev_z FROM bars))")
def win_devz25(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.deviation(bars(spark, d)), "dev_z", "dev_score")


@query(f"""SELECT symbol, date, distribution, absorption, CAST({over('sum', 'distribution', 25, 1)} AS BIGINT) AS dist_25 FROM (SELECT *,
  CAST(CASE WHEN close < lag(close) OVER {W} AND volume > lag(volume) OVER {W} THEN 1 ELSE 0 END AS INTEGER) AS distribution,
  CAST(CASE WHEN close >= lag(close) OVER {W} AND volume > lag(volume) OVER {W} THEN 1 ELSE 0 END AS INTEGER) AS absorption FROM bars)""")
def win_dist_days(spark: SparkSession, d: str) -> DataFrame:
    return ft.distribution_days(bars(spark, d)).select(*KEY, "distribution", "absorption", "dist_25")


@query(f"SELECT symbol, date, {r('cmf')} FROM (SELECT *, ({over('sum', 'flow', 20, 20)}) / nullif({over('sum', 'volume', 20, 20)}, 0) AS cmf FROM (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS flow FROM bars))")
def win_cmf20(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.money_flow(bars(spark, d)), "cmf")


_CONTEXT = [f"{k}_{n}" for k in ("vol", "trend") for n in (20, 63, 252)] + ["turnover_20", "turnover_63", "dd_252", "long_ret_252", "long_ret_2016"]


@query("SELECT symbol, date, " + ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in _CONTEXT) + " FROM (SELECT symbol, date, "
       + ", ".join(f"{over('stddev_pop', 'r1', n, m)} AS vol_{n}, close / nullif({over('avg', 'close', n, m)}, 0) - 1 AS trend_{n}" for n, m in ((20, 5), (63, 10), (252, 20))) + ", "
       + ", ".join(f"volume / nullif({over('avg', 'volume', n, m)}, 0) - 1 AS turnover_{n}" for n, m in ((20, 5), (63, 10)))
       + f", close / nullif({over('max', 'close', 252, 20)}, 0) - 1 AS dd_252, close / nullif(lag(close, 252) OVER {W}, 0) - 1 AS long_ret_252, close / nullif(lag(close, 2016) OVER {W}, 0) - 1 AS long_ret_2016 FROM (SELECT *, {RET} AS r1 FROM bars))")
def win_context(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.context(bars(spark, d)), *_CONTEXT)


@query("SELECT 'close' AS close_source, 'volume' AS volume_source, false AS is_proxy, 'gap_atr|ret_20' AS missing UNION ALL SELECT 'close', 'rvol20', true, 'gap_atr|atr_norm|ret_20'", uses=())
def win_context_sources(spark: SparkSession, d: str) -> DataFrame:
    """With a volume, and with a stand-in for it."""
    df = bars(spark, d)
    return ft.source_diagnostics(ft.atr_norm(df)).unionByName(ft.source_diagnostics(ft.volume(df).drop("volume")))


@query(f"SELECT symbol, date, {r('sig_20d', 'sig_8w', 'sig_6m')} FROM (SELECT *, {over('avg', 'close', 20, 1)} AS sig_20d, {over('avg', 'close', 40, 1)} AS sig_8w, {over('avg', 'close', 126, 1)} AS sig_6m FROM bars)")
def win_cluster_signal(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.cluster_signal(bars(spark, d)), "sig_20d", "sig_8w", "sig_6m")


_LONG = ["range_pos", "high_distance", "low_distance", "from_high", "from_low"]


@query(f"SELECT symbol, date, {r(*_LONG)} FROM (SELECT *, (close - lo) / nullif(hi - lo, 0) AS range_pos, (hi - close) / nullif(hi - lo, 0) AS high_distance, (close - lo) / nullif(hi - lo, 0) AS low_distance, close / nullif(hi, 0) - 1 AS from_high, close / nullif(lo, 0) - 1 AS from_low FROM (SELECT *, {over('max', 'close', 2016, 50)} AS hi, {over('min', 'close', 2016, 50)} AS lo FROM bars))")
def win_8y_context(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.long_context(bars(spark, d)), *_LONG)


def _rank_sql(x: str) -> str:
    a = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2015 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL AND len({a}) >= 50 THEN (len(list_filter({a}, lambda y: y < {x})) + (len(list_filter({a}, lambda y: y = {x})) + 1) / 2.0) / len({a}) END"


@query(f"""SELECT symbol, date, round({_rank_sql('a')}, 6) + 0.0 AS atr_rank, round({_rank_sql('b')}, 6) + 0.0 AS ret20_rank
  FROM (SELECT symbol, date, round(coalesce({over('avg', 'tr', 14, 14)} / nullif(lag(close) OVER {W}, 0), 0), 9) AS a, round(close / nullif(lag(close, 20) OVER {W}, 0) - 1, 9) AS b FROM (SELECT *, {TR} AS tr FROM bars))""")
def win_rolling_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    df = ft.returns(ft.atr_norm(bars(spark, d)), (20,)).withColumns({"atr_norm": F.round("atr_norm", 9), "ret_20": F.round("ret_20", 9)})
    return _out(ft.rolling_rank(df, {"atr_rank": "atr_norm", "ret20_rank": "ret_20"}), "atr_rank", "ret20_rank")


_EVAL = ["ma_dev", "ma_slope", "vol20", "dd20", "dd60", "volume_z"]


@query(f"""SELECT symbol, date, {r(*_EVAL)} FROM (SELECT symbol, date, close / nullif(ma20, 0) - 1 AS ma_dev, ma20 / nullif(lag(ma20, 5) OVER {W}, 0) - 1 AS ma_slope, {over('stddev_pop', 'r1', 20, 5)} * sqrt(252) AS vol20,
  close / nullif({over('max', 'close', 20, 1)}, 0) - 1 AS dd20, close / nullif({over('max', 'close', 60, 1)}, 0) - 1 AS dd60, (volume - {over('avg', 'volume', 20, 5)}) / nullif({over('stddev_pop', 'volume', 20, 5)}, 0) AS volume_z
  FROM (SELECT *, {RET} AS r1, {over('avg', 'close', 20, 5)} AS ma20 FROM bars))""")
def win_eval_features(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.evaluation(bars(spark, d)), *_EVAL)


@query(f"SELECT symbol, date, {r('fwd_1', 'fwd_5', 'fwd_vol_5', 'fwd_min_5')} FROM (SELECT *, {over('stddev_pop', 'ahead', 5, 3)} * sqrt(252) AS fwd_vol_5, lead(close) OVER {W} / close - 1 AS fwd_1, lead(close, 5) OVER {W} / close - 1 AS fwd_5, min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close - 1 AS fwd_min_5 FROM (SELECT *, lead(r1, 4) OVER {W} AS ahead FROM (SELECT *, {RET} AS r1 FROM bars)))")
def win_forward(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.forward(bars(spark, d)), "fwd_1", "fwd_5", "fwd_vol_5", "fwd_min_5")


@query(f"SELECT symbol, date, {r('next_ret')} FROM (SELECT *, coalesce(lead(close) OVER {W} / close - 1, 0) AS next_ret FROM bars)")
def win_next_return(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.next_return(bars(spark, d)), "next_ret")


@query(f"SELECT symbol, date, {r('delta', 'label_ret')} FROM (SELECT *, lead(close) OVER {W} - close AS delta, lead(close) OVER {W} / close - 1 AS label_ret FROM bars) WHERE delta IS NOT NULL")
def win_label(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.labelled(bars(spark, d)), "delta", "label_ret")


@query(f"SELECT symbol, date, lag(open) OVER {W} AS open, lag(high) OVER {W} AS high, lag(low) OVER {W} AS low, lag(close) OVER {W} AS close, lag(volume) OVER {W} AS volume FROM bars")
def win_shift1_obs(spark: SparkSession, d: str) -> DataFrame:
    return ft.observed(bars(spark, d)).select(*KEY, "open", "high", "low", "close", "volume")


@query(f"SELECT symbol, date, {r('prev_ret', 'prev_z')} FROM (SELECT *, pc / nullif(lag(pc) OVER {W}, 0) - 1 AS prev_ret, (pc - {over('avg', 'pc', 20, 20)}) / nullif({over('stddev_pop', 'pc', 20, 20)}, 0) AS prev_z FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars))")
def win_prev_features(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.previous_features(bars(spark, d)), "prev_ret", "prev_z")


@query(f"SELECT symbol, date, {r('z')} FROM (SELECT *, (close - {over('avg', 'close', 20, 20)}) / nullif({over('stddev_pop', 'close', 20, 20)}, 0) AS z FROM bars)")
def win_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.zscore(bars(spark, d)), "z")


@query("SELECT symbol, date, CAST(row_number() OVER (PARTITION BY symbol, date_trunc('week', date) ORDER BY date) - 1 AS INTEGER) AS week_index FROM bars")
def win_cal_week_index(spark: SparkSession, d: str) -> DataFrame:
    return ft.week_index(bars(spark, d)).select(*KEY, "week_index")


@query(f"""SELECT symbol, date, {r('env_pos', 'env_angle', 'env_hypot')}, env_rows FROM (SELECT symbol, date, (close - lo) / nullif(hi - lo, 0) AS env_pos, n AS env_rows, degrees(atan2(hi - lo, n)) AS env_angle, sqrt((hi - lo) ** 2 + n ** 2) AS env_hypot
  FROM (SELECT *, list_max(a) AS hi, list_min(a) AS lo, CAST(list_position(a, list_max(a)) - list_position(a, list_min(a)) AS BIGINT) AS n FROM (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM bars)))""")
def win_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.envelope(bars(spark, d)), "env_pos", "env_angle", "env_hypot", exact=("env_rows",))


@query(f"""SELECT symbol, date, {r('c5', 'm5', 'c4')} FROM (SELECT symbol, date, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c5,
  max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c4 FROM bars)""")
def win_centered(spark: SparkSession, d: str) -> DataFrame:
    return _out(bars(spark, d).withColumns({"c5": centered(F.avg, "close", 5, 1), "m5": centered(F.max, "close", 5, 1), "c4": centered(F.avg, "close", 4, 1)}), "c5", "m5", "c4")


@query(f"""SELECT symbol, date, {r('lr_vol', 'lr_mean')}, vol_bin, trend_bin, 3 * trend_bin + vol_bin AS phase FROM (SELECT m.*,
  CAST(CASE WHEN lr_vol IS NULL THEN 1 WHEN lr_vol <= v33 THEN 0 WHEN lr_vol <= v66 THEN 1 ELSE 2 END AS INTEGER) AS vol_bin,
  CAST(CASE WHEN lr_mean IS NULL THEN 1 WHEN lr_mean <= m33 THEN 0 WHEN lr_mean <= m66 THEN 1 ELSE 2 END AS INTEGER) AS trend_bin
  FROM m JOIN (SELECT symbol, quantile_cont(lr_vol, 0.33) AS v33, quantile_cont(lr_vol, 0.66) AS v66, quantile_cont(lr_mean, 0.33) AS m33, quantile_cont(lr_mean, 0.66) AS m66 FROM m GROUP BY symbol) q ON m.symbol = q.symbol)""",
       more=f"m AS (SELECT symbol, date, {over('stddev_samp', 'lr', 20, 5)} AS lr_vol, {over('avg', 'lr', 20, 5)} AS lr_mean FROM (SELECT *, ln(close / nullif(lag(close) OVER {W}, 0)) AS lr FROM bars))")
def win_logret_regime(spark: SparkSession, d: str) -> DataFrame:
    return _out(ft.log_return_regime(bars(spark, d)), "lr_vol", "lr_mean", exact=("vol_bin", "trend_bin", "phase"))


_NUMBERED = f"n AS (SELECT symbol, date, close, row_number() OVER {W} AS i, close - lag(close) OVER {W} AS diff FROM bars)"


@query(f"SELECT symbol, date, {r('fast', 'slow', digits=4)} FROM e", more=_NUMBERED + """, e AS (
  SELECT symbol, date, i, close AS fast, close AS slow FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.date, n.i, e.fast + 2 / 13.0::DOUBLE * (n.close - e.fast), e.slow + 2 / 27.0::DOUBLE * (n.close - e.slow) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)""", recursive=True)
def win_ewm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.ewm(bars(spark, d), {"fast": 2 / 13, "slow": 2 / 27}).select(*KEY, "fast", "slow"), "fast", "slow", digits=4)


@query(f"""SELECT symbol, date, round(fast - slow, 4) + 0.0 AS macd, round(sig, 4) + 0.0 AS macd_signal, CAST(CASE WHEN fast - slow - sig > 0 AND lag(fast - slow - sig) OVER {W} <= 0 THEN 1 ELSE 0 END AS INTEGER) AS macd_cross FROM e""", more=_NUMBERED + """, e AS (
  SELECT symbol, date, i, close AS fast, close AS slow, 0.0::DOUBLE AS sig FROM n WHERE i = 1 UNION ALL
  SELECT symbol, date, i, fast, slow, sig + 0.2::DOUBLE * (fast - slow - sig) FROM (
    SELECT n.symbol, n.date, n.i, e.fast + 2 / 13.0::DOUBLE * (n.close - e.fast) AS fast, e.slow + 2 / 27.0::DOUBLE * (n.close - e.slow) AS slow, e.sig FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1))""", recursive=True)
def win_macd_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.macd(bars(spark, d)).select(*KEY, "macd", "macd_signal", "macd_cross"), "macd", "macd_signal", digits=4)


@query("SELECT symbol, date, round(CASE WHEN i = 1 OR l = 0 THEN 50.0 ELSE 100 - 100 / (1 + g / l) END, 4) + 0.0 AS rsi FROM e", more=_NUMBERED + """, e AS (
  SELECT symbol, date, i, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.date, n.i, coalesce(e.g + (greatest(diff, 0) - e.g) / 14, greatest(diff, 0)), coalesce(e.l + (greatest(-diff, 0) - e.l) / 14, greatest(-diff, 0)) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)""", recursive=True)
def win_rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sq.rsi(bars(spark, d)).select(*KEY, "rsi"), "rsi", digits=4)
