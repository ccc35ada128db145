"""Publishing, contracts, snapshots, markers and policies: crashes, broken rules, late and repeated deliveries."""

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import policies as po
from barograph.sources import contracts as co
from barograph.sources import files as fs
from barograph.sources import snapshots as sn
from barograph.streaming import markers as mk


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(i)


def test_readers_see_a_whole_table_after_a_crash(spark, tmp_path, monkeypatch):
    place = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        fs.published(spark, place)
    fs.publish(spark.range(3), place)
    reader = fs.published(spark, place)
    with pytest.raises(Exception, match="divided"):
        fs.publish(spark.range(5).select(F.raise_error(F.lit("divided")).cast("long").alias("id")), place)
    assert fs.published(spark, place).count() == 3
    with monkeypatch.context() as m:
        m.setattr(fs, "_replace", lambda *a: (_ for _ in ()).throw(OSError("crash before the pointer moves")))
        with pytest.raises(OSError):
            fs.publish(spark.range(7), place)
    assert fs.published(spark, place).count() == 3
    fs.publish(spark.range(9), place)
    assert fs.published(spark, place).count() == 9 and reader.count() == 3  # who reads the version before may go on
    fs.publish(spark.range(1), place)
    assert len([x for x in os.listdir(tmp_path / "table") if x.startswith("v-")]) == 2
    text = f"file://{tmp_path}/doc.json"
    for n in range(3):
        fs.write_json_atomic(spark, json.dumps({"n": n}), text)
    assert fs.scan_json(spark, text, "n int").first()["n"] == 2 and [x for x in os.listdir(tmp_path) if x.startswith("doc")] == ["doc.json"]


def test_contracts_name_each_broken_rule_and_hold_back_the_table(spark, tmp_path):
    place = f"file://{tmp_path}/checked"
    df = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, None), (3, -3.0)], "id int, ratio double")
    contract = co.Contract(("id", "ratio"), {"ratio within limits": F.abs("ratio") <= 1, "id known": F.col("id").isNotNull()}, least_rows=3, key=("id",))
    report = co.write_checked(df, place, contract)
    assert report.broken == {"ratio within limits": 3, "id known": 0, "least_rows": 0, "distinct_key": 1} and not report.ok and report.place is None
    with pytest.raises(FileNotFoundError):
        fs.published(spark, place)
    assert not [x for x in os.listdir(tmp_path / "checked") if x.startswith("v-")]
    good = spark.range(2000).select(F.col("id").cast("int").alias("id"), F.lit(0.5).alias("ratio"))
    report = co.write_checked(good, place, contract)
    assert report.ok and report.n_rows == 2000 and fs.published(spark, place).count() == 2000
    assert co.write_checked(good.limit(2), place, contract).broken["least_rows"] == 1
    assert co.write_checked(good.drop("ratio"), place, contract).broken == {"column ratio": 1}
    assert fs.published(spark, place).count() == 2000


def snapshot_rows(spark, n=6, fail=False):
    df = spark.createDataFrame([(s, day(i), float(i), float(-i)) for s in ("a", "b") for i in range(n)], "symbol string, date date, close double, ma double")
    calendar = spark.createDataFrame([(day(i),) for i in range(0, 200, 2)], "date date")
    rows = sn.daily_sets(df, ["close"], ["ma"], calendar, {"weekday": F.dayofweek("at")}, lookback=3, months=1)
    return rows.withColumn("close", F.when(F.lit(fail) & (F.col("kind") == "window"), F.raise_error(F.lit("lost a task"))).otherwise(F.col("close"))) if fail else rows


def test_snapshots_name_every_file_and_survive_failed_jobs(spark, tmp_path):
    place = f"file://{tmp_path}/snap"
    assert sn.manifest(spark, place).count() == 0
    columns = {"prices": ["symbol", "at", "close"], "future": ["at", "weekday"]}
    sn.write(snapshot_rows(spark), place, columns)
    listed = sn.manifest(spark, place).collect()
    version = (tmp_path / "snap" / "CURRENT").read_text()
    there = {os.path.relpath(os.path.join(d, f), tmp_path / "snap" / version) for d, _, names in os.walk(tmp_path / "snap" / version) for f in names if f.endswith(".parquet")}
    assert {r["file"] for r in listed} == there and len(listed) == 4 * 6
    by = {k: sum(r["rows"] for r in listed if r["kind"] == k) for k in ("prices", "features", "window", "future")}
    assert (by["prices"], by["features"], by["window"]) == (12, 12, 2 * (1 + 2 + 3 * 4))
    assert by["future"] == sum(len([x for x in range(0, 200, 2) if day(i) < day(x) <= datetime.date(2024, 2, 1) + datetime.timedelta(i)]) for i in range(6))
    window = sn.read(spark, place, "window", "symbol string, at date, close double, ma double, weekday int").where("symbol = 'a'").groupBy("snapshot").agg(F.sort_array(F.collect_list("close")).alias("c"))
    assert {r["snapshot"]: r["c"] for r in window.collect()}[day(4)] == [2.0, 3.0, 4.0]
    assert spark.read.parquet(f"{place}/{version}/prices").columns == ["symbol", "at", "close"]
    with pytest.raises(Exception, match="lost a task"):
        sn.write(snapshot_rows(spark, fail=True), place, columns)
    assert (tmp_path / "snap" / "CURRENT").read_text() == version and [x for x in os.listdir(tmp_path / "snap") if x.startswith("v-")] == [version]
    killed = sn.SnapshotWriter(None, {"path": place})
    killed._text(f"{killed.version}/prices/half.parquet", "a job that was killed before its commit")
    assert {r["file"] for r in sn.manifest(spark, place).collect()} == there
    sn.write(snapshot_rows(spark, 2), place, columns)
    assert sn.manifest(spark, place).count() == 8


def test_markers_come_once_each_and_a_late_one_delays_only_its_day(spark, tmp_path):
    folder, journal, out = str(tmp_path / "m"), str(tmp_path / "j"), str(tmp_path / "out")

    def take():
        stream = mk.ready_days(spark, folder, journal)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [r["key"] for r in spark.read.parquet(out).orderBy("seq").collect()]

    mk.write_marker(folder, "step-1", "READY", "2024-01-01", "aa")
    mk.write_marker(folder, "step-2", "FAILED", "2024-01-02", "bb")
    mk.write_marker(folder, "step-3", "READY", "2024-01-03", "cc")
    (tmp_path / "m" / "torn.READY.json").write_text('{"day": ')
    assert take() == ["2024-01-01:aa", "2024-01-03:cc"]
    mk.write_marker(folder, "step-2", "READY", "2024-01-02", "bb")
    mk.write_marker(folder, "step-1", "READY", "2024-01-01", "aa")  # again
    mk.write_marker(folder, "other", "READY", "2024-01-03", "cc")  # the same key by another name
    assert take() == ["2024-01-01:aa", "2024-01-03:cc", "2024-01-02:bb"]
    mk.write_marker(folder, "step-1", "READY", "2024-01-01", "new")
    assert take() == take() == ["2024-01-01:aa", "2024-01-03:cc", "2024-01-02:bb", "2024-01-01:new"]


def test_local_paths_are_one_place(tmp_path):
    from barograph.sources.paths import file_system

    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert file_system(path)[1] == str(tmp_path)


def test_policies_are_the_row_by_row_version_s(spark, tmp_path):
    rng = np.random.default_rng(1)
    mlp = po.Policy([(rng.normal(size=(5, 3)), rng.normal(size=5)), (rng.normal(size=(1, 5)), np.array([0.1]))], rng.normal(size=3), np.array([1.0, 2.0, 0.5]))
    linear = po.Policy([(np.array([[0.5, -1.0, 2.0]]), np.array([0.0]))], 0.0, 1.0)
    narrow = po.Policy([(np.array([[1.0]]), np.array([0.0]))], 0.0, 1.0)
    broken = po.Policy([(np.array([[np.nan, 1.0, 1.0]]), np.array([0.0]))], 0.0, 1.0)
    path = po.save(spark, {"mlp": mlp, "linear": linear, "narrow": narrow, "broken": broken}, f"file://{tmp_path}/policies.npz")
    values = [[float(x) for x in rng.normal(size=3)] for _ in range(40)] + [[None, 1.0, 2.0], [float("inf"), float("nan"), 1.0]]
    rows = [(a, i, *v) for i, v in enumerate(values) for a in ("mlp", "linear", "narrow", "broken", "unknown", None)]
    got = po.act(spark.createDataFrame(rows, "agent string, i int, a double, b double, c double").repartition(5), "agent", ["a", "b", "c"], path, limit=0.9).collect()
    assert len(got) == len(rows)
    clean = lambda x: 0.0 if x is None or not np.isfinite(x) else x
    for r in got:
        x = np.array([clean(v) for v in values[r["i"]]])
        if r["agent"] == "mlp":
            h = np.tanh(mlp.layers[0][0] @ ((x - mlp.mu) / mlp.sd) + mlp.layers[0][1])
            want = np.tanh(mlp.layers[1][0] @ h + 0.1)[0]
        elif r["agent"] == "linear":
            want = np.tanh(0.5 * x[0] - x[1] + 2 * x[2])
        else:
            assert r["action"] == 0.0 and r["problem"] == {"narrow": "3 observations, 1 expected", "broken": "weights are not finite"}.get(r["agent"], "no policy")
            continue
        assert r["problem"] is None and r["action"] == pytest.approx(np.clip(want, -0.9, 0.9))
