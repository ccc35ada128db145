"""Regime fit against all paths of short series; the objective; test rows."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import regime_fit as rf


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(i)


@pytest.mark.parametrize("penalty", [0.0, 0.7, 100.0])
def test_best_path_is_that_of_all_paths(penalty):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7):
        costs = np.round(rng.normal(size=(n, 3)), 1)
        path, cost = rf.best_path(costs, penalty)
        value = lambda p: sum(costs[t, j] for t, j in enumerate(p)) + penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert cost == pytest.approx(min(value(p) for p in itertools.product(range(3), repeat=n))) == value(path.tolist())


def series(spark, n=120, seed=1):
    """Two symbols that change between two regimes each 30 rows."""
    rng, rows = np.random.default_rng(seed), []
    for s in ("a", "b"):
        for i in range(n):
            calm = (i // 30) % 2 == 0
            rows.append((s, day(i), float(rng.normal(0 if calm else 3, 0.3 if calm else 1.5)), float(rng.normal()), i < 90))
    return spark.createDataFrame(rows, "symbol string, date date, u double, v double, train boolean")


def test_fit_finds_regimes_and_never_gets_worse(spark):
    df = series(spark)
    rows = rf.stacked(df, ["u", "v"], 2)
    assert rows.count() == 2 * 119 and rows.orderBy("symbol", "date").first()["x"] == [x for r in df.where("symbol = 'a'").orderBy("date").limit(2).collect() for x in (r["u"], r["v"])]
    rows = rows.join(df.select("symbol", "date", "train"), ["symbol", "date"])
    model = rf.fit(rows.where("train"), 2, penalty=5.0)
    assert len(model.objective) > 1 and all(b <= a + 1e-9 * abs(a) for a, b in itertools.pairwise(model.objective))
    labels = {(r["symbol"], r["date"]): r["cluster"] for r in rf.assign(rows, model, "train").collect()}
    calm, wild = labels["a", day(10)], labels["a", day(45)]
    assert calm != wild
    assert np.mean([labels[s, day(i)] == (calm if (i // 30) % 2 == 0 else wild) for s in "ab" for i in range(1, 120)]) > 0.95
    # Rows after the training's end change neither the clusters nor labels before them.
    moved = rows.withColumn("x", F.when(F.col("date") > F.lit(day(100)), F.transform("x", lambda v: v + 50)).otherwise(F.col("x")))
    again = rf.fit(moved.where("train"), 2, penalty=5.0)
    assert np.allclose(again.means, model.means) and np.allclose(again.covs, model.covs)
    other = {(r["symbol"], r["date"]): r["cluster"] for r in rf.assign(moved, again, "train").collect()}
    assert all(other[k] == v for k, v in labels.items() if k[1] <= day(100))
    # And the order of rows or their partitions changes nothing.
    shuffled = rf.fit(rows.where("train").repartition(5, "date"), 2, penalty=5.0)
    assert np.allclose(shuffled.means, model.means)


def test_two_levels_and_small_clusters(spark):
    df = series(spark)
    rows = rf.stacked(df, ["u"], 1).join(df.select("symbol", "date", "train"), ["symbol", "date"])
    out = rf.fit_two_levels(rows, "train", 4, 2, penalty=2.0, rule=rf.Small(1.1, 1e9)).collect()
    assert len(out) == 240 and {r["stable"] for r in out} <= {0, 1} and all(r["rare"] for r in out)
    labels = spark.createDataFrame([("a", day(i), c) for i, c in enumerate([0, 0, 0, 1, 0, 0])], "symbol string, date date, cluster long")
    sizes = {r["cluster"]: (r["n"], r["mean_run"], r["small"]) for r in rf.small_clusters(labels, rf.Small(0.2, 2)).collect()}
    assert sizes == {0: (5, 2.5, False), 1: (1, 1.0, True)}
    with pytest.raises(ValueError, match="no rows"):
        rf.fit(rows.limit(0), 2, 1.0)
