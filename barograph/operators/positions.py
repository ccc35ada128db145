"""Positions over whole sorted tables: range partitions number their own rows, prefix sums of their counts give the offsets.

No task sees more than a range of rows, however large a group is, and no window runs over the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.sources.tables import materialize

_IN_TASK = (1 << 33) - 1  # monotonically_increasing_id: the lower bits count within a task


def _ascending(columns: list[str], descending: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first() for c in columns]


def positions(df: DataFrame, order: list[str], by: list[str] | None = None, descending: tuple[str, ...] = (), position: str = "position", total: str | None = None, tasks: int | None = None) -> DataFrame:
    """Adds ``position``: 0, 1, ... along ``order`` within each group ``by`` (one group if not given), and ``total``: the group's rows.

    Nulls come first, also as a group (last in ``descending`` columns). Rows that tie in all of ``order`` are numbered one after the other, as the
    written input has them; ties that should not depend on that need one more column in ``order``. ``tasks``: range
    partitions, as many as shuffles have unless given. ``df`` is written to the shared folder once, sorted, so the ranges
    stay as they are when a task runs again.
    """
    by = by or []
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    # A row's number in the written input parts even rows that are equal throughout, so no value makes a range too large.
    tied = materialize(df, "positions-input").withColumn("_tie", F.monotonically_increasing_id())
    keys = [*_ascending([*by, *order], descending), F.col("_tie")]
    ranged = tied.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumns({"_range": F.shiftright(at, 33).cast("int"), "_own": at.bitwiseAND(F.lit(_IN_TASK))}), "positions")

    # A row for each range, and one more for each group that begins inside a range.
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_first"))
    group = [F.col(b) for b in by] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = counts.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("_range").alias("_r"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_g{i}"))
    out = [*names, (F.col("_own") + F.col("_before")).alias(position)]
    return placed.join(offsets, same).select(*out, *([F.col("_total").alias(total)] if total else []))


def align(left: DataFrame, right: DataFrame, order: list[str], by: list[str] | None = None, suffix: str = "_right") -> DataFrame:
    """Row n of ``left`` beside row n of ``right``, both in ``order`` within each group; the longer one's rest has nulls beside it.

    Columns of ``right`` besides ``by`` get ``suffix``.
    """
    by = by or []
    a = positions(left, order, by)
    b = positions(right, order, by)
    b = b.select(*[F.col(c).alias(f"{c}{suffix}") for c in b.columns])
    same = F.col("position") == F.col(f"position{suffix}")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    joined = a.join(b, same, "full")
    keep = [F.coalesce(F.col(c), F.col(f"{c}{suffix}")).alias(c) for c in [*by, "position"]]
    return joined.select(*keep, *[c for c in left.columns if c not in by], *[f"{c}{suffix}" for c in right.columns if c not in by])
