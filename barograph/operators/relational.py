"""Joins, fills, deduplication, splits and set operations on keyed daily tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``. Never dropDuplicates, whose choice is arbitrary."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def join_features(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_r") -> DataFrame:
    """Left join; columns of the right that clash get the suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), keys, "left")


def combine_first(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Full join in which known values of ``base`` win over those of ``other``."""
    shared = [c for c in base.columns if c in other.columns and c not in keys]
    joined = base.join(other.withColumnsRenamed({c: f"_o_{c}" for c in shared}), keys, "full_outer")
    return joined.withColumns({c: F.coalesce(c, f"_o_{c}") for c in shared}).drop(*[f"_o_{c}" for c in shared])


def pair(df: DataFrame, first: str, second: str, value: str = "close") -> DataFrame:
    """Two symbols on their common dates; one aggregate, no self-join."""
    both = df.where(F.col("symbol").isin(first, second)).groupBy("date").agg(F.max(F.when(F.col("symbol") == first, F.col(value))).alias("a"), F.max(F.when(F.col("symbol") == second, F.col(value))).alias("b"))
    return both.where("a is not null and b is not null")


def outer_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), tables)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the right row of the same ``by`` and the greatest ``on`` that is at or before (or before) its own.

    Only the left's distinct (by, on) are matched, by sorting them and the right together: series of daily rows, however
    many left rows share a day. An equi-join gives the left rows what was found; a null ``on`` finds nothing.
    """
    marked = F.struct(*[F.col(v) for v in values], F.col(on).alias("matched_on"))
    r = right.select(*by, on, F.lit(1 if strict else 0).alias("_side"), marked.alias("_right"))
    asked = left.select(*by, on).distinct().withColumn("_side", F.lit(0 if strict else 1))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_right", ignorenulls=True).over(w))
    found = both.where("_right is null").select(*by, on, "_found")
    rest = [c for c in left.columns if c not in by and c != on]
    return left.join(found, [*by, on], "left").select(*by, on, *rest, *[F.col(f"_found.{v}").alias(v) for v in [*values, "matched_on"]])


def fill_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each date of each interval."""
    return df.withColumn("date", F.explode(F.sequence(start, end)))


def spread_intervals(rows: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (by, date) with id and direction of the interval that covers the date, the greatest id of several; then filled
    forward and back along ``by``."""
    each = fill_dates(intervals, "start", "end").groupBy(*by, "date").agg(F.max("id").alias("id"), F.max_by("direction", "id").alias("direction"))
    w = Window.partitionBy(*by).orderBy("date")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead))
    out = rows.join(each, [*by, "date"], "left")
    return out.select(*rows.columns, fill("id").alias("id"), fill("direction").alias("direction"))


def intervals_of(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, order: list[str], bucket_days: int = 32, by: list[str] | None = None) -> DataFrame:
    """Each point with the first interval (by ``order``) of its ``by`` that contains it, or none.

    Intervals are dealt to the buckets of days that they touch and points to theirs, so the join is an equi-join.
    """
    day = lambda c: F.unix_date(c)
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(day(start) / bucket_days), F.floor(day(end) / bucket_days))))
    ps = points.withColumn("_cell", F.floor(day(point) / bucket_days))
    keys = points.columns
    hit = ps.join(cells, ["_cell", *(by or [])]).where(F.col(point).between(F.col(start), F.col(end)))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_cell")
    return points.join(first, keys, "left")


def overlaps(a: DataFrame, b: DataFrame, by: list[str], metric: str = "iou", least: float = 0.0, max_mid_days: int | None = None, same_direction: bool = True, bucket_days: int = 32) -> DataFrame:
    """by, a_id, b_id, shared_days, score, lag_days of intervals (by, id, direction, start, end) of one key that share days.

    Days are differences of dates. ``score``: the days shared, by those from the first start to the last end (iou), by a's
    (a_cov) or by b's (b_cov); pairs without a shared day or below ``least`` are left out. ``lag_days``: a's middle less b's, rounded down;
    at most ``max_mid_days`` from 0. Intervals are dealt to buckets of days, so the join is an equi-join on key,
    direction and bucket.
    """
    day = F.unix_date
    keys = [*by, "direction"] if same_direction else by

    def cells(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([*keys, "id", "start", "end"])])
        return out.withColumn(f"{p}_cell", F.explode(F.sequence(F.floor(day(f"{p}_start") / bucket_days), F.floor(day(f"{p}_end") / bucket_days))))

    same = F.col("a_cell") == F.col("b_cell")
    for c in keys:
        same &= F.col(f"a_{c}") == F.col(f"b_{c}")
    both = cells(a, "a").join(cells(b, "b"), same)
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    both = both.where(lo < hi).where(F.floor(day(lo) / bucket_days) == F.col("a_cell"))  # each pair once: in the cell where it begins
    shared = F.datediff(hi, lo)
    of = {"iou": F.datediff(F.greatest("a_end", "b_end"), F.least("a_start", "b_start")), "a_cov": F.datediff("a_end", "a_start"), "b_cov": F.datediff("b_end", "b_start")}[metric]
    lag = F.floor((day("a_start") + day("a_end") - day("b_start") - day("b_end")) / 2)
    out = both.select(*[F.col(f"a_{c}").alias(c) for c in by], "a_id", "b_id", shared.cast("long").alias("shared_days"), (shared / of).alias("score"), lag.alias("lag_days"))
    out = out.where(F.col("score") >= least)
    return out if max_mid_days is None else out.where(F.abs("lag_days") <= max_mid_days)


def split_assign(date: Column, train: tuple[str, str], test: tuple[str, str]) -> Column:
    """test, train or other by closed ranges; test wins."""
    inside = lambda r: date.between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    return F.when(inside(test), "test").when(inside(train), "train").otherwise("other")


def split_windows(df: DataFrame, train_years: int = 2, test_months: int = 3) -> DataFrame:
    """symbol, train_start, train_end, test_start, test_end: the last months, and the years before, on days that exist."""
    last = df.groupBy("symbol").agg(F.max("date").alias("test_end"))
    aim = last.withColumns({"_test": F.add_months("test_end", -test_months), "_train": F.add_months("test_end", -test_months - 12 * train_years)})
    snapped = df.select("symbol", "date").join(aim, "symbol").groupBy("symbol", "test_end").agg(
        F.min(F.when(F.col("date") >= F.col("_train"), F.col("date"))).alias("train_start"),
        F.max(F.when(F.col("date") < F.col("_test"), F.col("date"))).alias("train_end"),
        F.min(F.when(F.col("date") >= F.col("_test"), F.col("date"))).alias("test_start"),
    )
    return snapped.select("symbol", "train_start", "train_end", "test_start", "test_end")


def resolve_split(df: DataFrame, test_start: str | None = None, split: str = "split") -> DataFrame:
    """Adds ``split`` and ``split_source``: of the column where there is one (trimmed, in lower case); else by the given first
    day of the test; else where the last run of dates begins; else, without any date, all rows are test.

    ``df`` has symbol and date. Rows without a date are train where dates decide.
    """
    if split in df.columns:
        return df.withColumns({split: F.lower(F.trim(split)), "split_source": F.lit("csv")})
    if test_start is not None:
        dated = df.select("symbol", "date").where("date is not null").select("symbol").distinct().withColumn("_start", F.lit(test_start).cast("date"))
        source = "summary"
    else:
        dated, source = last_island_start(df.where("date is not null")).withColumnRenamed("test_start", "_start"), "date_infer"
    out = df.join(dated, "symbol", "left")
    by_date = F.when(F.col("date") >= F.col("_start"), "test").otherwise("train")
    return out.withColumns({split: F.when(F.col("_start").isNull(), "test").otherwise(by_date), "split_source": F.when(F.col("_start").isNull(), "fallback_all_test").otherwise(source)}).drop("_start")


def last_island_start(dates: DataFrame, gap_days: int = 3) -> DataFrame:
    """symbol, test_start: where the last run of dates without a longer gap begins; the middle date if that run is one of several."""
    w = Window.partitionBy("symbol").orderBy("date")
    marked = dates.select("symbol", "date").distinct().withColumn("new", F.when(F.datediff("date", F.lag("date").over(w)) <= gap_days, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy("symbol", "run").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("n"))
    last = runs.groupBy("symbol").agg(F.max_by("start", "run").alias("start"), F.max_by("n", "run").alias("n"))
    middle = dates.select("symbol", "date").distinct().groupBy("symbol").agg(F.array_sort(F.collect_list("date")).alias("all"))  # the calendar's days
    middle = middle.select("symbol", F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("mid"))
    return last.join(middle, "symbol").select("symbol", F.when(F.col("n") > 1, F.col("start")).otherwise(F.col("mid")).alias("test_start"))


def join_quality(left: DataFrame, right: DataFrame, keys: list[str], value: str, warm_up: int, by: str) -> DataFrame:
    """Per ``by``: rows, matched share after the first ``warm_up`` rows, share of non-zero values, and PASS or FAIL."""
    w = Window.partitionBy(by).orderBy(*[k for k in keys if k != by])
    seen = left.select(*keys).withColumn("_n", F.row_number().over(w)).join(right.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_hit")), keys, "left").where(F.col("_n") > warm_up)
    out = seen.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.coalesce("_hit", F.lit(0))).alias("matched"), F.avg(F.when(F.coalesce("_v", F.lit(0.0)) != 0, 1).otherwise(0)).alias("nonzero"))
    return out.withColumn("verdict", F.when((F.col("matched") >= 0.95) & (F.col("nonzero") >= 0.80), "PASS").otherwise("FAIL"))


def compare_columns(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """column, n, mean_abs, max_abs of the differences on common keys."""
    both = a.select(*keys, *columns).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns]), keys)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"_b_{c}")).alias("d")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count("d").alias("n"), F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"))


def interpolate(df: DataFrame, value: str, by: str = "symbol", order: str = "date") -> DataFrame:
    """Linear interpolation by row over inner nulls; outer ones take the nearest known value."""
    w = Window.partitionBy(by).orderBy(order)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_n", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_n"), F.col(value).alias("_v")))
    df = df.withColumns({"_a": F.last(known, ignorenulls=True).over(past), "_b": F.first(known, ignorenulls=True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    between = a["_v"] + (b["_v"] - a["_v"]) * F.try_divide((F.col("_n") - a["_n"]).cast("double"), (b["_n"] - a["_n"]).cast("double"))
    return df.withColumn(value, F.coalesce(F.col(value), between, a["_v"], b["_v"])).drop("_n", "_a", "_b")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace or join those of ``base``."""
    return combine_first(new, base, keys).select(*base.columns)
