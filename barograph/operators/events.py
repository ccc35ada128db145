"""Turning points and events of a series: extrema of centred windows, a choice among them along the series, and geometry.

As DataFrame operators the extrema come from windows, and only they reach the choice; as a table function the same choice
streams through a partition with a window of rows in memory.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

WINDOW, MIN_GAP = 20, 10
TOP, BOTTOM = "TOP", "BOTTOM"


class Point(NamedTuple):
    row: int
    date: Any
    value: float
    kind: str

    def beats(self, other: Point) -> bool:
        return self.value > other.value if self.kind == TOP else self.value < other.value


class Choice:
    """Takes extrema in order of their rows and gives turning points once they are final.

    First, of those less than ``min_gap`` rows after the last one kept, only a more extreme one of its kind takes its place.
    Then tops and bottoms alternate: of neighbours of one kind the most extreme stays.
    """

    def __init__(self, min_gap: int) -> None:
        self.min_gap = min_gap
        self.near: Point | None = None
        self.turn: Point | None = None

    def push(self, p: Point) -> Iterator[Point]:
        if self.near is not None and p.row - self.near.row < self.min_gap:
            if p.kind == self.near.kind and p.beats(self.near):
                self.near = p
            return
        yield from self._kept()
        self.near = p

    def _kept(self) -> Iterator[Point]:
        if self.near is None:
            return
        if self.turn is None or self.turn.kind != self.near.kind:
            if self.turn is not None:
                yield self.turn
            self.turn = self.near
        elif self.near.beats(self.turn):
            self.turn = self.near

    def end(self) -> Iterator[Point]:
        yield from self._kept()
        if self.turn is not None:
            yield self.turn
        self.near = self.turn = None


def extrema(df: DataFrame, by: str, at: str, value: str, window: int = WINDOW) -> DataFrame:
    """by, row, date, value, kind of rows that are the greatest or least of a whole centred window; rows without a value are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(at).alias("date"), F.col(value).cast("double").alias("value"))
    order, around = Window.partitionBy(by).orderBy("date"), Window.partitionBy(by).orderBy("date").rowsBetween(-(window // 2), (window - 1) // 2)
    whole = F.count("value").over(around) == window
    kinds = F.array_compact(F.array(F.when(F.col("value") == F.max("value").over(around), TOP), F.when(F.col("value") == F.min("value").over(around), BOTTOM)))
    found = rows.select(by, "date", "value", F.row_number().over(order).cast("long").alias("row"), F.when(whole, kinds).alias("kinds"))
    return found.select(by, "row", "date", "value", F.explode("kinds").alias("kind"))


def turning_points(df: DataFrame, by: str = "symbol", at: str = "date", value: str = "close", window: int = WINDOW, min_gap: int = MIN_GAP) -> DataFrame:
    """by, row, date, value, kind of the chosen extrema. A series' extrema go through one task; series spread."""
    found = extrema(df, by, at, value, window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "kind"], ascending=[True, False])  # a flat window's top comes before its bottom
        choice, out = Choice(min_gap), []
        for p in pdf.itertuples(index=False):
            out += choice.push(Point(p.row, p.date, p.value, p.kind))
        out += choice.end()
        return pd.DataFrame([(pdf[by].iloc[0], *p) for p in out], columns=pdf.columns)

    return found.groupBy(by).applyInPandas(run, found.select(by, "row", "date", "value", "kind").schema)


def events(points: DataFrame, by: str = "symbol", window: int = WINDOW) -> DataFrame:
    """by, id (from 0), direction, start, end, n_bars and geometry of the segments between neighbouring turning points."""
    w = Window.partitionBy(by).orderBy("row")
    lead = lambda c: F.lead(c).over(w)
    nxt = points.select(by, "row", F.col("date").alias("start"), F.col("value").alias("v0"), F.col("kind").alias("start_kind"), (F.row_number().over(w) - 1).cast("long").alias("id"), lead("date").alias("end"), lead("value").alias("v1"), lead("kind").alias("end_kind"), (lead("row") - F.col("row")).alias("n_bars")).where("end is not null")
    move, bars = F.col("v1") - F.col("v0"), F.col("n_bars").cast("double")
    share = lambda x: F.when(F.col("v0") != 0, x / F.col("v0") * 100)
    angle = F.degrees(F.atan2(move, bars))
    high, low = F.greatest("v0", "v1"), F.least("v0", "v1")
    direction = F.when((F.col("start_kind") == BOTTOM) & (F.col("end_kind") == TOP), "UP").otherwise("DOWN")
    return nxt.select(by, "id", direction.alias("direction"), "start", "end", "n_bars", move.alias("move"), share(move).alias("move_pct"), angle.alias("angle"), (angle / 90).alias("angle_norm"), (bars / window).alias("length_norm"), high.alias("high"), low.alias("low"), share(high).alias("high_pct"), share(low).alias("low_pct"))


_NUMBERS = ("move", "move_pct", "angle", "angle_norm", "length_norm", "high", "low", "high_pct", "low_pct")


class SeriesEvents:
    """Table function: ``series_events(TABLE(t), key, at, value, window, min_gap)`` gives each series' events.

    It asks for the rows of a key in one partition and in order of time. It holds a window of rows, so a series may be longer than memory.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, value: AnalyzeArgument, window: AnalyzeArgument, min_gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(a.value is None for a in (key, at, value, window, min_gap)):
            raise ValueError("series_events takes a table, names of its key, time and value, and two numbers, all constant")
        fields = {f.name: f.dataType for f in rows.dataType}
        if missing := [a.value for a in (key, at, value) if a.value not in fields]:
            raise ValueError(f"the table has no {', '.join(missing)}")
        if window.value < 1 or min_gap.value < 0:
            raise ValueError("window and min_gap must be positive")
        schema = StructType().add(key.value, fields[key.value]).add("id", LongType()).add("direction", StringType())
        schema.add("start", fields[at.value]).add("end", fields[at.value]).add("n_bars", LongType())
        for name in _NUMBERS:
            schema.add(name, DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value)])

    def __init__(self) -> None:
        self.held: deque[Point] = deque()
        self.n = self.n_events = 0
        self.key = self.choice = self.before = None
        self.window = WINDOW

    def eval(self, row: Row, key: str, at: str, value: str, window: int, min_gap: int) -> Iterator[tuple]:
        if self.choice is None:
            self.key, self.window, self.choice = row[key], window, Choice(min_gap)
        if row[value] is None or math.isnan(row[value]):
            return
        self.n += 1
        self.held.append(Point(self.n, row[at], float(row[value]), ""))
        if len(self.held) > window:
            self.held.popleft()
        if len(self.held) == window:
            p, values = self.held[window // 2], [x.value for x in self.held]
            for kind, edge in ((TOP, max(values)), (BOTTOM, min(values))):
                if p.value == edge:
                    yield from self._events(self.choice.push(p._replace(kind=kind)))

    def terminate(self) -> Iterator[tuple]:
        if self.choice is not None:
            yield from self._events(self.choice.end())

    def _events(self, points: Iterator[Point]) -> Iterator[tuple]:
        for p in points:
            if (a := self.before) is not None:
                move, bars = p.value - a.value, p.row - a.row
                share = lambda x: x / a.value * 100 if a.value else None  # noqa: E731, B023
                angle, high, low = math.degrees(math.atan2(move, bars)), max(a.value, p.value), min(a.value, p.value)
                yield self.key, self.n_events, "UP" if a.kind == BOTTOM else "DOWN", a.date, p.date, bars, move, share(move), angle, angle / 90, bars / self.window, high, low, share(high), share(low)
                self.n_events += 1
            self.before = p


def register(spark: SparkSession, name: str = "series_events") -> UserDefinedTableFunction:
    """Makes the table function known to SQL."""
    return spark.udtf.register(name, F.udtf(SeriesEvents))
