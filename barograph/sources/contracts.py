"""Contracts of tables, measured while they are written: no second scan, and nothing is published that breaks one."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barograph.sources import files


class Contract(NamedTuple):
    """``columns`` that must be there; ``rules``: a condition for every row, by name (null counts as broken); ``least_rows``;
    ``key``: columns whose values are distinct, up to the error of a sketch (see ``distinct_share``)."""

    columns: tuple[str, ...] = ()
    rules: dict[str, Column] = {}
    least_rows: int = 0
    key: tuple[str, ...] = ()


#: Distinct keys that a sketch must find, as a share of the rows; it errs by 0.0081 (one deviation) with 2**14 registers.
DISTINCT_SHARE, LG_REGISTERS = 0.95, 14


class Report(NamedTuple):
    """Rows that break each rule; ``place``: where the table is published, or null."""

    broken: dict[str, int]
    n_rows: int
    place: str | None

    @property
    def ok(self) -> bool:
        return not any(self.broken.values())


def write_checked(df: DataFrame, place: str, contract: Contract) -> Report:
    """Stages ``df`` and counts, in the same job, the rows that break a rule; publishes only a table that breaks none."""
    missing = {f"column {c}": 1 for c in contract.columns if c not in df.columns}
    if missing:
        return Report(missing, 0, None)
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    metrics = [F.count(F.lit(1)).alias("n_rows")]
    names = list(contract.rules)
    metrics += [F.count(F.when(~F.coalesce(contract.rules[name], F.lit(False)), 1)).alias(f"rule_{i}") for i, name in enumerate(names)]
    if contract.key:
        metrics.append(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*contract.key), LG_REGISTERS)).alias("n_keys"))
    version = files.stage(df.observe(seen, *metrics), place)
    got = seen.get
    broken = {name: int(got[f"rule_{i}"]) for i, name in enumerate(names)}
    n_rows = int(got["n_rows"])
    broken["least_rows"] = max(0, contract.least_rows - n_rows)
    if contract.key:
        lost = n_rows - int(got["n_keys"])
        broken["distinct_key"] = lost if lost > (1 - DISTINCT_SHARE) * n_rows else 0
    report = Report(broken, n_rows, None)
    if not report.ok:
        files.unstage(df.sparkSession, place, version)
        return report
    return report._replace(place=files.point(df.sparkSession, place, version))
