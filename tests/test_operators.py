"""Operators on small made-up series: nulls, ties, single rows, zero denominators."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barograph.functions import calendar as cal
from barograph.operators import aggregates as ag
from barograph.operators import audits as au
from barograph.operators import events as ev
from barograph.operators import features as ft
from barograph.operators import relational as rel
from barograph.operators import routing as rt
from barograph.operators import sequential as sq
from barograph.operators import signals as sg
from barograph.sources import files as fs
from barograph.streaming import live

D0 = datetime.date(2024, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


def bars(spark, closes, symbol="A"):
    rows = [(symbol, day(i), c, None if c is None else c + 1, None if c is None else c - 1, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_returns_fill_a_missing_close(spark):
    assert column(ft.returns(bars(spark, [1.0, None, 2.0]), (1,)), "ret_1") == [None, 0.0, 1.0]


def test_zero_denominators_are_null_or_filled(spark):
    df = bars(spark, [0.0, 1.0])
    assert column(ft.returns(df, (1,)), "ret_1") == [None, None]
    assert column(ft.gap(df), "gap") == [0.0, 0.0]
    assert column(ft.zscore(bars(spark, [1.0] * 20)), "z")[-1] is None


def test_volume_of_one_row(spark):
    r = ft.volume(bars(spark, [1.0])).first()
    assert (r["rvol20"], r["volz20"]) == (1.0, 0.0)


def test_rolling_rank_averages_ties(spark):
    out = column(ft.rolling_rank(bars(spark, [1.0, 2.0, 2.0]), {"rank_pct": "close"}, 3, 1), "rank_pct")
    assert out == pytest.approx([1.0, 1.0, (1 + 1.5) / 3])


@pytest.mark.parametrize("n", [1, 2, 40])
def test_macd_and_rsi_follow_pandas(spark, n):
    closes = pd.Series(np.random.default_rng(n).uniform(1, 2, n))
    line = closes.ewm(span=12, adjust=False).mean() - closes.ewm(span=26, adjust=False).mean()
    assert column(sq.macd(bars(spark, closes.tolist())), "macd") == pytest.approx(line.tolist())
    assert column(sq.rsi(bars(spark, closes.tolist())), "rsi")[0] == 50.0


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "A", day(0)), (2, "A", day(5)), (3, "B", day(5))], "id int, symbol string, date date")
    right = spark.createDataFrame([("A", day(1), 10.0), ("A", day(5), 50.0)], "symbol string, date date, x double")
    get = lambda strict: {r["id"]: r["x"] for r in rel.asof(left, right, "date", ["symbol"], ["x"], strict).collect()}
    assert get(False) == {1: None, 2: 50.0, 3: None}
    assert get(True) == {1: None, 2: 10.0, 3: None}


def test_overlaps_count_each_pair_once(spark):
    iv = lambda rows: spark.createDataFrame([("s", i, "UP", day(a), day(b)) for i, a, b in rows], "symbol string, id int, direction string, start date, end date")
    other = iv([(7, 100, 300), (8, 201, 202), (9, 200, 210)])
    out = rel.overlaps(iv([(1, 0, 200)]), other, ["symbol"]).collect()
    assert [(r["a_id"], r["b_id"], r["shared_days"], r["score"], r["lag_days"]) for r in out] == [(1, 7, 100, 100 / 300, -100)]
    assert rel.overlaps(iv([(1, 0, 200)]), other, ["symbol"], metric="a_cov").first()["score"] == 0.5
    assert rel.overlaps(iv([(1, 0, 200)]), other, ["symbol"], max_mid_days=99).count() == rel.overlaps(iv([(1, 0, 200)]), other, ["symbol"], least=0.4).count() == 0
    assert rel.overlaps(iv([(1, 0, 200)]), other.withColumn("symbol", F.lit("t")), ["symbol"]).count() == 0
    down = other.withColumn("direction", F.lit("DOWN"))
    assert rel.overlaps(iv([(1, 0, 200)]), down, ["symbol"]).count() == 0 and rel.overlaps(iv([(1, 0, 200)]), down, ["symbol"], same_direction=False).count() == 1


def test_interpolation_and_outer_values(spark):
    df = bars(spark, [None, 1.0, None, 3.0, None])
    assert column(rel.interpolate(df, "close"), "close") == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_combine_first_and_upsert(spark):
    a = spark.createDataFrame([(1, None), (2, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "k int, x double")
    assert {r["k"]: r["x"] for r in rel.combine_first(a, b, ["k"]).collect()} == {1: 9.0, 2: 2.0, 3: 7.0}
    assert {r["k"]: r["x"] for r in rel.upsert(b, a, ["k"]).collect()} == {1: 9.0, 2: 2.0, 3: 7.0}


def test_drawdown_starts_at_the_first_equity(spark):
    df = spark.createDataFrame([("a", day(0), -0.5), ("a", day(1), 1.0)], "agent string, date date, ret double")
    assert column(ag.with_drawdown(df, ["agent"]), "drawdown") == pytest.approx([0.0, 0.0])
    assert ag.return_metrics(df, ["agent"]).first()["multiple"] == pytest.approx(1.0)


def test_empty_tables(spark):
    none = bars(spark, [1.0]).where("false")
    assert ft.context(none).count() == ag.split_metrics(none, ["symbol"]).count() == ev.turning_points(none).count() == 0


def test_reward_alignment_finds_a_leak(spark):
    log = spark.createDataFrame([("a", day(0), 0.1, 0.0), ("a", day(1), 0.2, 0.1), ("a", day(2), 0.0, 0.25)], "agent string, date date, reward_next double, logged double")
    r = au.reward_alignment(log).first()
    assert not r["ok"] and r["worst_date"] == day(2) and r["max_error"] == pytest.approx(0.05)


def test_min_hold_and_greedy_match(spark):
    df = spark.createDataFrame([("s", day(i), x) for i, x in enumerate([1, 2, 2, 2, 1])], "symbol string, date date, want int")
    assert column(sq.min_hold(df, "want", 2, "symbol"), "held") == [1, 1, 2, 2, 1]
    pairs = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.7), ("g", 2, 2, 0.1)], "g string, a int, b int, s double")
    assert {(r["a"], r["b"]) for r in sq.greedy_match(pairs, ["g"], "a", "b", "s").collect()} == {(1, 1), (2, 2)}
    assert {(r["a"], r["b"]) for r in sq.match_in_order(pairs, ["g"], "a", "b", "s").collect()} == {(1, 1), (2, 2)}


def router_days(spark, regime=1, allowed=("a1", "a2"), agents=(("a1", 1.0, 0.01, 1.0), ("a2", 0.5, 0.02, 0.0)), n=1):
    schema = "date date, regime_id int, r_long double, r_short double, allowed array<string>, agents array<struct<agent: string, ratio: double, ret: double, score: double>>"
    return spark.createDataFrame([(day(i), regime, 0.01, -0.01, list(allowed) if allowed is not None else None, list(agents)) for i in range(n)], schema)


def test_reward_modes_differ_as_they_should(spark):
    out = rt.router_simulation(router_days(spark), beta=100.0, ema=1.0, cost_bps=0.0, switch=0.1, churn=0.1, regret=1.0)
    reward = {r["mode"]: r["reward"] for r in out.collect()}
    assert reward["legacy"] > reward["profit_basic"] and reward["profit_regret"] <= reward["legacy"]
    first = out.first()
    assert first["ratio"] == pytest.approx(0.7) and first["ret_selected"] == pytest.approx(0.007) and first["ret_best"] == 0.02


def test_router_falls_back_to_safe_agents_and_caps(spark):
    unknown = rt.router_simulation(router_days(spark, regime=-1), modes=("legacy",), safe=("a2",)).first()
    assert (unknown["allowed_source"], unknown["selected"], unknown["weight"]) == ("regime_unknown", "a2", 1.0)
    nobody = rt.router_simulation(router_days(spark, allowed=("zz",)), modes=("legacy",), safe=("a1",)).first()
    assert (nobody["allowed_source"], nobody["selected"]) == ("fallback_safe_set", "a1")
    assert rt._capped(np.array([0.7, 0.3]), 0.6) == pytest.approx([0.6 / 0.957142857, 1 - 0.6 / 0.957142857], abs=1e-6)
    assert rt._capped(np.array([0.4, 0.35, 0.25]), 0.5) == pytest.approx([0.4, 0.35, 0.25])
    assert rt._capped(np.array([1.0, 0.0]), 0.6) == pytest.approx([1.0, 0.0])  # an only agent keeps all
    no_scores = rt.router_simulation(router_days(spark, agents=(("a1", 1.0, None, None), ("a2", -1.0, None, 0.5))), modes=("profit_regret",)).first()
    assert no_scores["ratio"] == 0.0 and no_scores["ret_best"] == no_scores["ret_selected"]


def test_splits_resolve_in_four_ways(spark):
    schema = "symbol string, date date"
    dated = spark.createDataFrame([("s", datetime.date(2024, 1, 1)), ("s", datetime.date(2024, 1, 2)), ("s", datetime.date(2024, 6, 1)), ("s", datetime.date(2024, 6, 2))], schema)
    split = lambda df: {(r["split_source"], r["split"]): r["count"] for r in df.groupBy("split_source", "split").count().collect()}
    assert split(rel.resolve_split(dated.withColumn("split", F.lit(" Test")))) == {("csv", "test"): 4}
    assert split(rel.resolve_split(dated, "2024-01-02")) == {("summary", "train"): 1, ("summary", "test"): 3}
    assert split(rel.resolve_split(dated)) == {("date_infer", "train"): 2, ("date_infer", "test"): 2}
    assert split(rel.resolve_split(spark.createDataFrame([("s", None), ("s", None)], schema))) == {("fallback_all_test", "test"): 2}


def test_publishing_needs_every_mode(spark, tmp_path):
    sim = rt.router_simulation(router_days(spark, n=3))
    ranks = rt.reward_mode_ranks(sim)
    rows = fs.published(spark, fs.publish_best(sim, ranks, "mode", rt.MODES)).collect()
    assert len(rows) == 3 and {r["mode"] for r in rows} == {ranks.where("is_best").first()["mode"]}
    with pytest.raises(ValueError, match="profit_basic"):
        fs.publish_best(sim.where("mode <> 'profit_basic'"), ranks, "mode", rt.MODES)
    place = f"file://{tmp_path}/table"
    fs.publish(sim, place)
    fs.publish(sim.limit(1), place)
    assert fs.published(spark, place).count() == 1


def test_streams_take_files_in_any_order_and_none(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    hours = lambda hs: [(h, datetime.datetime(2024, 1, 1 + h // 24, h % 24, 5), "x", 1.0) for h in hs]
    for i, hs in enumerate([range(60, 90), range(0, 30), range(30, 60)]):
        spark.createDataFrame(hours(hs), schema).coalesce(1).write.parquet(f"file://{tmp_path}/e.parquet/{i}")
    folder, name = f"file://{tmp_path}", "e.parquet/"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/e.parquet")
    flat = f"file://{tmp_path}/flat"
    rows.repartition(3, "event_id").write.parquet(f"{flat}/e.parquet")
    late = live.spread(spark, flat, "e.parquet", "ts")
    out = live.last_updates(live.run_updates(live.windowed_counts(live.replay(spark, flat, "e.parquet"), late=late)), ["start", "event_type"])
    assert out.agg(F.sum("n")).first()[0] == 90 and out.count() == 90
    twice = live.replay(spark, flat, "e.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert live.run_to_table(live.first_of_each(twice, ["event_id"], late)).count() == 90
    spark.createDataFrame([], schema).write.parquet(f"{flat}/none.parquet")
    nothing = live.replay(spark, flat, "none.parquet")
    assert live.run_updates(live.windowed_counts(nothing, late=live.spread(spark, flat, "none.parquet", "ts"))).count() == 0
    assert name


def turns_by_hand(x, window, gap):
    """Extrema of centred windows; the gap from the last one that passed it, before tops and bottoms alternate."""
    before, after = window // 2, (window - 1) // 2
    found = []
    for i in range(before, len(x) - after):
        around = x[i - before : i + after + 1]
        found += [(i, "TOP")] * (x[i] == max(around)) + [(i, "BOTTOM")] * (x[i] == min(around))
    better = lambda i, j, kind: x[i] > x[j] if kind == "TOP" else x[i] < x[j]
    passed, out = [], []
    for i, kind in found:
        if passed and i - passed[-1][0] < gap:
            if passed[-1][1] == kind and better(i, passed[-1][0], kind):
                passed[-1] = (i, kind)
        else:
            passed.append((i, kind))
    for i, kind in passed:
        if out and out[-1][1] == kind:
            out[-1] = (i, kind) if better(i, out[-1][0], kind) else out[-1]
        else:
            out.append((i, kind))
    return out


@pytest.mark.parametrize("window,gap", [(3, 3), (6, 4), (20, 10), (1, 0)])
def test_turning_points_and_events_are_brute_force_s(spark, window, gap):
    x = np.round(np.cumsum(np.random.default_rng(4).normal(0, 0.02, 300)) + 5, 2)  # with ties
    kept = turns_by_hand(x.tolist(), window, gap)
    df = bars(spark, x.tolist())
    points = ev.turning_points(df, window=window, min_gap=gap)
    assert sorted((r["row"] - 1, r["kind"]) for r in points.collect()) == sorted(kept) and len(kept) > 5
    events = ev.events(points, window=window).orderBy("id").collect()
    pairs = list(zip(kept, kept[1:], strict=False))
    assert [(r["start"], r["end"], r["direction"], r["n_bars"]) for r in events] == [(day(a), day(b), "UP" if k == "BOTTOM" else "DOWN", b - a) for (a, k), (b, _) in pairs]
    assert [r["move"] for r in events] == pytest.approx([x[b] - x[a] for (a, _), (b, _) in pairs])
    assert [r["angle_norm"] for r in events] == pytest.approx([np.degrees(np.arctan2(x[b] - x[a], b - a)) / 90 for (a, _), (b, _) in pairs])
    ev.register(spark)
    again = spark.sql(f"SELECT * FROM series_events(TABLE({{t}}), 'symbol', 'date', 'close', {window}, {gap})", t=df.repartition(3))
    rows = again.orderBy("id").collect()
    assert [tuple(r)[:6] for r in rows] == [tuple(r)[:6] for r in events]
    assert [x for r in rows for x in tuple(r)[6:]] == pytest.approx([x for r in events for x in tuple(r)[6:]])


def test_gap_is_measured_before_kinds_alternate(spark):
    # A top at 1, a lower one at 5, a bottom at 7: less than 3 rows after the lower top, so it is none.
    x = [1.0, 9.0, 5.0, 4.0, 4.5, 8.0, 2.0, 1.5, 3.0]
    assert [(r["row"] - 1, r["kind"]) for r in ev.turning_points(bars(spark, x), window=3, min_gap=3).orderBy("row").collect()] == [(1, "TOP")]


def test_table_function_says_what_is_missing(spark):
    ev.register(spark)
    with pytest.raises(Exception, match="the table has no nothing"):
        spark.sql("SELECT * FROM series_events(TABLE({t}), 'symbol', 'date', 'nothing', 3, 3)", t=bars(spark, [1.0]))
    short = bars(spark, [1.0, None, float("nan"), 2.0])
    assert spark.sql("SELECT * FROM series_events(TABLE({t}), 'symbol', 'date', 'close', 3, 3)", t=short).count() == 0


def test_longitudes_are_those_of_the_orbits(spark):
    dates = [datetime.date(1990, 2, 3), datetime.date(2003, 8, 28), datetime.date(2024, 2, 29)]
    d = np.array([(x - datetime.date(2000, 1, 1)).days - 0.5 for x in dates])

    def place(body):
        node, incl, peri, a, e, m = (v + rate * d for v, rate in cal.ELEMENTS[body][:6])
        node, incl, peri, m = (np.radians(x) for x in (node, incl, peri, m))
        full = m.copy()
        for _ in range(50):
            full = m + e * np.sin(full)
        true = 2 * np.arctan2(np.sqrt(1 + e) * np.sin(full / 2), np.sqrt(1 - e) * np.cos(full / 2))
        r, u = a * (1 - e * np.cos(full)), true + peri
        return r * (np.cos(node) * np.cos(u) - np.sin(node) * np.sin(u) * np.cos(incl)), r * (np.sin(node) * np.cos(u) + np.cos(node) * np.sin(u) * np.cos(incl))

    rows = cal.geocentric(spark.createDataFrame([(x,) for x in dates], "date date"), *cal.PLANETS).collect()
    ex, ey = place("earth")
    for planet in cal.PLANETS:
        x, y = place(planet)
        want = np.degrees(np.arctan2(y - ey, x - ex)) % 360
        got = [r["longitude"] for r in sorted(rows, key=lambda r: r["date"]) if r["planet"] == planet]
        assert got == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("n", [32, 33, 100, 257])
def test_wavelet_bands_sum_to_the_series(n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    levels = sg.wavelet_levels(n, 3)
    bands, low = sg.wavelet_bands(x, levels)
    assert bands.sum(axis=0) + low == pytest.approx(x)
    if n % 8 == 0:  # of even lengths throughout the bands are orthogonal
        assert abs(bands[0] @ bands[1]) < 1e-8 and abs(bands[0] @ low) < 1e-8
    flat, _ = sg.wavelet_bands(np.full(n, 5.0), levels)
    assert np.abs(flat).max() < 1e-9


def test_phase_lag_finds_a_shift():
    t = np.arange(256)
    x = np.sin(2 * np.pi * t / 64) + 0.5 * np.sin(2 * np.pi * t / 32)
    for shift in (0, 1, 3):
        assert sg.phase_lag(x, np.roll(x, shift))[0] == pytest.approx(shift, abs=0.05)
    assert sg.phase_lag(x, np.roll(x, 9), most=2.0)[0] == 2.0
    assert np.isnan(sg.phase_lag(x[:3], x[:3])[0])


def test_bootstrap_is_near_the_shares(spark):
    days = spark.createDataFrame([(day(i), int(i % 10 >= 7)) for i in range(400)], "date date, regime_id int")
    out = {r["regime_id"]: r for r in ag.bootstrap(days, "regime_id", 40).collect()}
    assert out[0]["occupancy_mean"] == pytest.approx(0.7, abs=0.03) and 0.005 < out[0]["occupancy_std"] < 0.06
    assert out[0]["bootstrap_stability"] == pytest.approx(1 / (1 + out[0]["occupancy_std"]))
    # With copies in a row and gaps, a row's predecessor has its label more often than 6 in 7 times.
    assert out[0]["co_membership_stability"] > out[1]["co_membership_stability"] > 0.5


def test_robust_pca_follows_numpy(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=200)
    x = np.stack([a, 2 * a + rng.normal(size=200) * 0.1, rng.normal(size=200)], axis=1)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i int, a double, b double, c double")
    got = np.array([[r["pc_1"], r["pc_2"]] for r in ag.robust_pca(df, ["a", "b", "c"], 2).orderBy("i").collect()])
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z = (x - q[1]) / (q[2] - q[0])
    z = z - z.mean(axis=0)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][:2].T
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6


def test_cash_environment_is_the_step_by_step_book(spark):
    prices, acts = [10.0, 11.0, 9.0, 9.0, 12.0], [0.5, -0.5, 1.0, 0.0, 0.3]
    df = spark.createDataFrame([("s", day(i), p, a) for i, (p, a) in enumerate(zip(prices, acts, strict=True))], "symbol string, date date, close double, action double")
    got = sg.cash_environment(df, "action", "close", cost=0.01).orderBy("date").collect()
    cash, shares = 1.0, 0.0
    for r, p, a in zip(got, prices, acts, strict=True):
        equity = cash + shares * p
        equity -= 0.01 * abs(a * equity - shares * p)
        shares, cash = a * equity / p, equity - a * equity
        assert (r["equity"], r["shares"], r["cash"]) == pytest.approx((equity, shares, cash))


def test_holidays_are_the_federal_ones(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    ends = spark.createDataFrame([(datetime.date(1990, 1, 1), datetime.date(2030, 12, 31))], "start date, end date")
    got = {r["date"] for r in cal.sessions(ends, "start", "end").collect()}
    want = pd.bdate_range("1990-01-01", "2030-12-31").difference(USFederalHolidayCalendar().holidays("1989-12-01", "2031-01-31"))
    assert got == {d.date() for d in want}


def test_speed_is_the_gradient_of_the_unwrapped_longitude(spark):
    days = [day(i) for i in range(0, 700) if i % 7 < 5]
    rows = cal.geocentric(spark.createDataFrame([(d,) for d in days], "date date"), "mercury").orderBy("date").collect()
    lon = np.unwrap(np.radians([r["longitude"] for r in rows]))
    want = np.gradient(lon, np.array([d.toordinal() for d in days], float))
    assert [r["speed"] for r in rows] == pytest.approx(want.tolist(), abs=1e-9)
    assert any(r["retrograde"] for r in rows) and not all(r["retrograde"] for r in rows)


def test_weekdays_and_numbers(spark):
    sat = spark.createDataFrame([(datetime.date(2024, 3, 2), "1,234"), (datetime.date(2024, 3, 1), "x")], "d date, t string")
    out = sat.select(cal.next_weekday(F.col("d"), 1).alias("n"), cal.number(F.col("t")).alias("x")).collect()
    assert [tuple(r) for r in out] == [(datetime.date(2024, 3, 4), 1234.0), (datetime.date(2024, 3, 4), None)]


def test_contract_and_names():
    assert fs.suspicious(["close", "fwd_1", "label"]) == ["fwd_1", "label"]


def test_router_of_regimes_without_lists_and_with_given_weights(spark):
    from barograph.operators import routing as rt

    free = rt.router_simulation(router_days(spark).withColumn("allowed", F.lit(None).cast("array<string>")), modes=("legacy",), safe=("a2",)).first()
    assert free["allowed_source"] == "regime_topk" and free["weight"] < 1.0  # all agents, not the safe ones
    nobody = rt.router_simulation(router_days(spark, regime=-1), modes=("legacy",)).first()
    assert nobody["allowed_source"] == "fallback_safe_set"
    out = rt.router_simulation(router_days(spark), modes=("legacy",), excluded=("a1",)).collect()
    assert {r["selected"] for r in out} == {"a2"}
    fixed = router_days(spark).withColumn("fixed", F.create_map(F.lit("a1"), F.lit(1.0), F.lit("a2"), F.lit(3.0)))
    given = rt.router_simulation(fixed, modes=("legacy",)).first()
    assert (given["allowed_source"], given["selected"], given["weight"]) == ("meta_router", "a2", 0.75)
    with pytest.raises(Exception, match="every agent is excluded"):
        rt.router_simulation(router_days(spark), modes=("legacy",), excluded=("a1", "a2")).collect()


def test_routing_queries_read_their_tables_a_few_times(spark):
    from barograph.plans import catalog

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    for name in ("seq_allowlist", "seq_fallback_policy", "seq_fallback_rates", "seq_usage_audit"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("/root/testdata/sf0.001") <= 3, name
        assert plan.count("FileScan") <= 12, (name, plan.count("FileScan"))


def test_greedy_match_is_brute_force_s(spark):
    rng, rows = np.random.default_rng(3), []
    for s in ("x", "y"):
        for i in range(40):
            rows += [(s, i, int(j), float(rng.choice([0.2, 0.5, 0.9])), int(rng.integers(-9, 9))) for j in rng.choice(40, 4, replace=False)]
    pairs = spark.createDataFrame(rows, "g string, a int, b int, s double, lag int")
    want, a, b = set(), set(), set()
    for g, i, j, score, lag in sorted(rows, key=lambda r: (-r[3], abs(r[4]), r[1], r[2])):
        if (g, i) not in a and (g, j) not in b:
            want.add((g, i, j))
            a.add((g, i))
            b.add((g, j))
    assert {(r["g"], r["a"], r["b"]) for r in sq.greedy_match(pairs, ["g"], "a", "b", "s", "lag").collect()} == want


def test_percentiles_of_sets_are_exact_also_where_the_sketch_is_off(spark, monkeypatch):
    from barograph.operators import timings as tm

    rng = np.random.default_rng(2)
    rows = [(s, int(a), day(int(rng.integers(0, 4))), float(v)) for s in ("x", "y") for a in range(3) for v in np.round(rng.exponential(10, 700 if s == "x" else 3), 1)]
    rows += [("x", None, day(1), None), ("x", 9, day(1), float("nan")), (None, 1, day(2), 5.0)] + [("hot", 1, day(0), 2.0)] * 900
    df = spark.createDataFrame(rows, "step string, agent int, day date, value double")
    dims, sets = ["step", "agent"], tm.all_sets(["step", "agent"])
    want = {}
    for own in sets:
        by = {}
        for s, a, _, v in rows:
            key = (3 - (2 * ("step" in own) + ("agent" in own)), s if "step" in own else None, a if "agent" in own else None)
            by.setdefault(key, []).extend([v] if v is not None and v == v else [])
        want |= {k: (len(v), *([round(float(np.quantile(v, p)), 9) for p in (0.5, 0.95)] if v else [None, None])) for k, v in by.items()}
    get = lambda: {(r["set_id"], r["step"], r["agent"]): (r["n"], *[None if r[c] is None else round(r[c], 9) for c in ("p50", "p95")]) for r in tm.percentiles(df, F.col("day"), dims, sets, "value").collect()}
    assert get() == want
    monkeypatch.setattr(tm, "MARGIN", 0.0)  # now intervals miss
    assert get() == want


def test_positions_over_whole_tables(spark):
    from barograph.operators.positions import align, positions

    rows = [(g, v) for g in ("a", None, "b") for v in [3, 1, 1, None, 2] * 40] + [("one", 7)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = positions(df, ["v"], ["g"], total="n", tasks=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["position"], r["v"], r["n"]))
    for g, own in by.items():
        values = sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v))
        assert sorted(own) == [(i, v, len(values)) for i, v in enumerate(values)] if None not in values else [x[1] for x in sorted(own, key=lambda x: x[0])] == values
        assert {x[2] for x in own} == {len(values)}
    down = positions(df, ["v"], descending=("v",), tasks=3).orderBy("position").collect()
    assert [r["v"] for r in down] == sorted((v for _, v in rows), key=lambda v: (v is None, -(v or 0))) and [r["position"] for r in down] == list(range(len(rows)))
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "k int, s string")
    pairs = align(a, spark.createDataFrame([(10,), (5,)], "k int"), ["k"]).orderBy("position").collect()
    assert [(r["k"], r["s"], r["k_right"]) for r in pairs] == [(1, "y", 5), (2, "z", 10), (3, "x", None)]
    assert positions(df.limit(0), ["v"]).count() == 0


def test_windows_are_the_same_for_any_ranges(spark):
    from barograph.operators import tensors as tn

    x = [float(v) for v in np.round(np.random.default_rng(8).normal(10, 3, 200), 3)]
    x[20], x[50], x[60] = None, -1.0, float("inf")
    df = bars(spark, x).select("symbol", "date", "close").withColumn("k", F.col("close") * 2)
    for mode in tn.MODES:
        get = lambda rows: {r["date"]: (tuple(r["x"]), tuple(r["y"])) for r in tn.windows(df, ["close", "k"], "close", 12, 4, mode, rows=rows).collect()}  # noqa: E731, B023
        whole, parts, tiny = get(10_000), get(10), get(3)
        assert repr(whole) == repr(parts) == repr(tiny) and len(whole) == 200 - 11
        assert all(len(a) == 24 and len(b) == 4 for a, b in whole.values())
    clean = lambda v: 0.0 if v is None or not np.isfinite(v) else v
    window, ahead = whole[day(30)]
    assert window == pytest.approx([f * clean(v) for v in x[19:31] for f in (1, 2)]) and ahead == pytest.approx([np.log(v / x[30]) for v in x[31:35]])
    assert whole[day(49)][1][0] is None and whole[day(199)][1] == (None,) * 4 and whole[day(50)][1] == (None,) * 4
    one = spark.range(1).select(F.lit(8.0).alias("c"), F.lit(10.0).alias("n"))
    for mode in tn.MODES:
        assert one.select(tn.inverse(tn.target(F.col("n"), F.col("c"), mode), F.col("c"), mode)).first()[0] == pytest.approx(10.0)
    assert one.select(tn.inverse(F.lit(500.0), F.col("c"), "logret")).first()[0] == pytest.approx(8 * np.exp(20))
    assert one.select(tn.target(F.col("n"), F.lit(0.0), "ret"), tn.inverse(F.lit(0.1), F.lit(-1.0), "delta"), tn.inverse(F.lit(None).cast("double"), F.col("c"), "logret")).first() == (None, None, None)


def test_reward_alignment_checks_equity_too(spark):
    rows = [(a, day(i), 0.01 * (i % 3), 0.01 * ((i - 1) % 3) if i else 0.0) for a in ("x", "y", "z") for i in range(9)]
    log = spark.createDataFrame(rows, "agent string, date date, reward_next double, logged double")
    w = Window.partitionBy("agent").orderBy("date")
    log = log.withColumn("equity", 5 * F.exp(F.sum(F.log1p("logged")).over(w)))
    off = (F.col("agent") == "z") & (F.col("date") == F.lit(day(4)))
    log = log.withColumn("equity", F.when(off, F.col("equity") * 1.01).otherwise(F.col("equity")))
    log = log.withColumn("logged", F.when((F.col("agent") == "y") & (F.col("date") == F.lit(day(6))), 0.5).otherwise(F.col("logged")))
    got = {r["agent"]: r for r in au.reward_alignment(log, equity="equity").collect()}
    assert (got["x"]["ok"], got["y"]["ok"], got["z"]["ok"]) == (True, False, False)
    assert got["y"]["worst_date"] == day(6) and got["z"]["max_error"] <= 1e-12 and got["z"]["equity_error"] == pytest.approx(0.01 / 1.01)


def test_implied_returns_rank_the_true_pair_first(spark):
    rng = np.random.default_rng(6)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.02, 60))
    opened, pos = close * (1 + rng.normal(0, 0.01, 60)), rng.uniform(0.2, 1, 60)
    rows = [("s", day(i), float(opened[i]), float(close[i]), float(pos[i]), float(pos[i - 1] * (close[i] / close[i - 1] - 1)) if i else None, 0.0) for i in range(60)]
    out = au.implied_returns(spark.createDataFrame(rows, "symbol string, date date, open double, close double, pos double, ret double, cost double"))
    assert out.count() == 16
    best = out.orderBy("rank").first()
    assert (best["implied"], best["definition"], best["n"]) == ("before", "cc_same", 59) and best["mae"] < 1e-12


def test_monthly_matches_by_hand(spark):
    rows = [(datetime.date(2024, m, i + 1), k, float(v)) for m, k, v in ((1, 0, 10), (1, 1, 20), (2, 0, 19), (2, 1, 12), (3, 2, 11), (3, 0, 40)) for i in range(3)]
    df = spark.createDataFrame(rows, "date date, k int, v double")
    got = {(r["month"], r["previous"], r["current"], r["distance"], r["kept"], r["kept_rate"]) for r in ag.monthly_matches(df, "k", ["v"], F.when(F.max("v") > 15, "high").otherwise("low")).collect()}
    # Months of 1: 0 is near 1 (2) and 1 near 0 (1); of February: 1 is near 2 (1), 0 is left with 0 (21).
    assert got == {("2024-01", 1, 0, 1.0, True, 1.0), ("2024-01", 0, 1, 2.0, True, 1.0), ("2024-02", 1, 2, 1.0, False, 0.5), ("2024-02", 0, 0, 21.0, True, 0.5)}


def test_reports_fall_back(spark):
    from barograph.operators import reports as rp

    rows = [("eq", day(i), "test" if i else "train", None, e, 0.5) for i, e in enumerate([1.0, 2.0, None, 3.0, 1.5])]
    rows += [("flat", day(i), None, 0.01, None, 0.0) for i in range(3)] + [("early", day(0), None, 0.1, 1.0, 1.0)] + [("zero", day(i), "TEST ", x, 0.0, h) for i, (x, h) in enumerate([(0.1, 1.0), (-0.1, 0.0), (0.2, -1.0), (0.0, 0.3)])]
    df = spark.createDataFrame(rows, "k string, date date, split string, ret double, equity double, ratio double")
    got = {r["k"]: r for r in rp.report(df, ["k"], str(day(1))).collect()}
    e = got["eq"]
    assert (e["basis"], e["derived"], e["test_days"], e["avg_hold_days"]) == ("split=test", True, 4, 4.0)
    assert e["total_return_pct"] == pytest.approx(-25) and e["max_dd_pct"] == pytest.approx(-50) and e["avg_daily_ret"] == pytest.approx(0.0) and e["win_rate"] == 0.5
    f = got["flat"]
    assert (f["basis"], f["test_days"], f["sharpe"], f["avg_hold_days"], f["total_return_pct"]) == (f"date>={day(1)}", 2, None, None, None)
    assert (got["early"]["basis"], got["early"]["test_days"]) == (None, 0)
    z = got["zero"]
    assert z["total_return_pct"] is None and z["max_dd_pct"] is None and z["avg_hold_days"] == 1.5 and z["win_rate"] == 0.5
    assert {r["basis"] for r in rp.report(df.drop("split").withColumn("split", F.lit(None).cast("string")), ["k"]).collect()} == {"all_rows"}


def test_horizons_by_name(spark):
    from barograph.operators import horizons as hz

    assert hz.horizon_columns(["a", "Pred_Close_h1", "pred_close_scaled_h1", "CLOSE_PRED_h010", "pred_h5", "pred_close_x_h7"], without=("_x_",)) == {1: "pred_close_scaled_h1", 10: "CLOSE_PRED_h010"}
    assert hz.horizon_columns(["close_pred", "Pred_Close"]) == {1: "Pred_Close"} and hz.horizon_columns(["close"]) == {}
    df = spark.createDataFrame([(5.0, 9.0)], "p5 double, p9 double")
    out, sources = hz.fill_horizons(df, (1, 5, 7, 9, 20), {5: "p5", 9: "p9"})
    assert sources == {1: 5, 5: 5, 7: 5, 9: 9, 20: 9} and tuple(out.first())[2:] == (5.0, 5.0, 5.0, 9.0, 9.0)
    assert hz.fill_horizons(df, (2,), {})[0].first()["h02"] == 0.0


def test_profile_labels(spark):
    base = {c: 0.0 for c in ag.PROFILE}
    rows = [("calm", {}), ("panic", {"panic": 9.0, "vol20": 9.0}), ("up", {"ret_20": 9.0, "ret_60": 9.0}), ("down", {"ret_20": -9.0, "ret_60": -9.0, "vol20": 4.0})]
    df = spark.createDataFrame([(n, *(base | x).values()) for n, x in rows], "name string, " + ", ".join(f"{c} double" for c in ag.PROFILE))
    got = {r["name"]: r for r in ag.profile_labels(df).collect()}
    assert got["panic"]["label"] == ag.PANIC and got["up"]["label"] == ag.RISING and got["down"]["label"] == ag.FALLING
    r = got["up"]
    assert r["separability"] == pytest.approx((r["trend"] ** 2 + r["vol"] ** 2 + r["drawdown"] ** 2 + r["panic_score"] ** 2) ** 0.5)
    assert ag.profile_labels(df.limit(1)).first()["label"] == ag.UNCLEAR
