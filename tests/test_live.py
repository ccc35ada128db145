"""Streams with state: the live router stopped, started, late, idle and from a saved position."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barograph.streaming import router as lr

SETTINGS = lr.Settings({0: ["A", "B"], 1: ["B", "C"], 2: ["D"], -1: ["A"]})


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(i)


def book_days(spark, n=20):
    rng = random.Random(1)
    rows = [(b, day(i), rng.randrange(3), [(a, rng.uniform(-1, 1), None if i % 7 == 0 else rng.choice([0.1, 0.2, 0.5])) for a in "ABCD"[: 3 + i % 2]]) for b in ("x", "y") for i in range(n)]
    return spark.createDataFrame(rows, lr.DAYS)


def decided(df):
    return sorted((r["book"], r["date"], r["candidates"], r["branches"], r["weights"], r["ratio"]) for r in df.where("NOT late").collect())


def test_live_router_is_the_batch_s_after_stops_and_drops_late_days(spark, tmp_path):
    days = book_days(spark)
    early = F.col("date") < F.lit(day(8))
    late = days.where(F.col("date") == F.lit(day(3)))
    got = lr.replay_parts([days.where(early), days.where(~early).unionByName(late)], str(tmp_path), SETTINGS).cache()
    assert decided(got) == decided(lr.route_all(days, SETTINGS)) and got.count() == 42
    assert {(r["book"], r["date"], r["ratio"]) for r in got.where("late").collect()} == {("x", day(3), None), ("y", day(3), None)}


def test_live_router_forgets_idle_books(spark, tmp_path):
    days = book_days(spark, 23)
    parts = [days.where(F.col("date") <= F.lit(day(4))), days.where((F.col("book") == "y") & (F.col("date") == F.lit(day(19)))), days.where((F.col("book") == "x") & (F.col("date") > F.lit(day(19))))]
    got = lr.replay_parts(parts, str(tmp_path), SETTINGS, idle_days=5)
    fresh = lr.route_all(days.where((F.col("book") == "x") & (F.col("date") > F.lit(day(19)))), SETTINGS)
    assert decided(got.where((F.col("book") == "x") & (F.col("date") > F.lit(day(19))))) == decided(fresh)


def test_step_by_hand():
    book = lr.Book()
    one = {"date": day(0), "regime_id": 0, "agents": [{"agent": "A", "ratio": 1.0, "score": 0.3}, {"agent": "B", "ratio": -1.0, "score": 0.3}]}
    book, (_, candidates, branches, weights, ratio) = lr.step(book, one, SETTINGS)
    assert (candidates, branches, weights, ratio) == ([], ["A"], [1.0], 1.0)  # nothing is expected yet: the safe agent
    book, (_, candidates, branches, weights, ratio) = lr.step(book, one | {"date": day(1)}, SETTINGS)
    assert (candidates, branches) == ([0], ["A", "B"]) and weights == pytest.approx([0.85, 0.15]) and ratio == pytest.approx(0.7)
    assert book.moves == {(0, 0): (1, 1)}
    book, (_, candidates, branches, _, _) = lr.step(book, one | {"date": day(2), "regime_id": 2}, SETTINGS)
    assert (candidates, branches) == ([0], ["A", "B"])  # D is in no list that was expected
    assert lr.next_regimes(book._replace(moves={(2, 1): (3, 5), (2, 0): (3, 2), (2, 2): (4, 9)}), 2) == [2, 0]


def test_state_forgets_keys_behind_the_watermark(spark):
    from barograph.streaming import live

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    part = lambda hours: spark.createDataFrame([(h, at(h)) for h in hours], "event_id long, ts timestamp")
    plan = lambda s: live.first_of_each(s, ["event_id"], "2 hours")
    got = live.deliver([part(range(50)), part([*range(50, 100), 49]), part([100, 101, 3, 4, 5])], plan)
    assert got.rows.count() == 102 and got.dropped == 3 and got.kept < 10
    with pytest.raises(ValueError, match="nothing"):
        live.deliver([], plan)
