"""The live router as a stream: each book's position, averaged weights and regime transitions are state between days.

A day is taken once and in order: rows of a day that a book already has, or of an earlier one, change nothing and come out
as late. The same step makes the batch version, so a replay in any number of parts, stopped and started again, gives its rows.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAYS = "book string, date date, regime_id int, agents array<struct<agent: string, ratio: double, score: double>>"
DECISIONS = "book string, date date, regime_id int, candidates array<int>, branches array<string>, weights array<double>, ratio double, late boolean"


class Settings(NamedTuple):
    """``lists``: allowed agents of each regime, -1 those that are always safe. ``top``: regimes that may come next."""

    lists: dict[int, list[str]]
    top: int = 2
    beta: float = 5.0
    share: float = 0.3
    limit: float = 1.0


class Book(NamedTuple):
    """What is kept of a book: its last day, averaged weights, and of each (regime, next regime) how often and since which day."""

    date: datetime.date | None = None
    regime: int | None = None
    ratio: float = 0.0
    days: int = 0
    weights: dict[str, float] = {}
    moves: dict[tuple[int, int], tuple[int, int]] = {}


def next_regimes(book: Book, top: int) -> list[int]:
    """The regimes that most often came after the last one (of equals the one seen first), or the last one if none is known."""
    if book.regime is None:
        return []
    known = sorted((-n, since, to) for (before, to), (n, since) in book.moves.items() if before == book.regime)
    return [to for _, _, to in known[: max(1, top)]] or [book.regime]


def step(book: Book, day: Any, s: Settings) -> tuple[Book, tuple]:
    """The book after the day, and what it decided: regime, candidates, branches, their weights, position."""
    ratios = {a["agent"]: a["ratio"] or 0.0 for a in day["agents"]}
    scores = {a["agent"]: a["score"] for a in day["agents"]}
    candidates, safe = next_regimes(book, s.top), s.lists.get(-1, [])
    first = sorted({a for r in candidates for a in s.lists.get(r, [])}.union(safe) & ratios.keys()) or sorted(ratios)
    branches = [a for a in s.lists.get(day["regime_id"], safe) if a in first] or first
    known = [scores[a] for a in branches]
    if any(x is None or math.isnan(x) for x in known):
        raw = [1.0] * len(branches)
    else:
        raw = [math.exp(s.beta * (x - max(known))) for x in known]
    total = sum(raw)
    mean = [s.share * x / total + (1 - s.share) * book.weights.get(a, 0.0) for a, x in zip(branches, raw, strict=True)]
    weights = [x / sum(mean) for x in mean] if sum(mean) > 0 else [1 / len(branches)] * len(branches)
    ratio = max(-s.limit, min(s.limit, sum(w * ratios[a] for a, w in zip(branches, weights, strict=True))))
    moves = dict(book.moves)
    if book.regime is not None:
        n, since = moves.get((book.regime, day["regime_id"]), (0, book.days))
        moves[book.regime, day["regime_id"]] = n + 1, since
    after = Book(day["date"], day["regime_id"], ratio, book.days + 1, dict(zip(branches, weights, strict=True)), moves)
    return after, (day["regime_id"], candidates, branches, weights, ratio)


class LiveRouter(StatefulProcessor):
    """``idle_days``: a book without rows for so long, by the watermark, is forgotten; None: never."""

    def __init__(self, settings: Settings, idle_days: int | None = None) -> None:
        self.settings, self.idle_days = settings, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "date date, regime int, ratio double, days int")
        self.weights = handle.getMapState("weights", "agent string", "weight double")
        self.moves = handle.getMapState("moves", "before int, after int", "n int, since int")

    def _read(self) -> Book:
        if not self.last.exists():
            return Book()
        date, regime, ratio, days = self.last.get()
        weights = {k[0]: v[0] for k, v in self.weights.iterator()}
        return Book(date, regime, ratio, days, weights, {(k[0], k[1]): (v[0], v[1]) for k, v in self.moves.iterator()})

    def _write(self, book: Book) -> None:
        self.last.update((book.date, book.regime, book.ratio, book.days))
        self.weights.clear()
        for k, v in book.weights.items():
            self.weights.updateValue((k,), (v,))
        for k, v in book.moves.items():
            self.moves.updateValue(k, v)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        book = self._read()
        for row in sorted(rows, key=lambda r: r["date"]):
            if book.date is not None and row["date"] <= book.date:
                yield Row(book=key[0], date=row["date"], regime_id=row["regime_id"], candidates=None, branches=None, weights=None, ratio=None, late=True)
                continue
            book, (regime, candidates, branches, weights, ratio) = step(book, row, self.settings)
            yield Row(book=key[0], date=row["date"], regime_id=regime, candidates=candidates, branches=branches, weights=weights, ratio=ratio, late=False)
        self._write(book)
        if self.idle_days is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            end = datetime.datetime.combine(book.date, datetime.time(), datetime.UTC) + datetime.timedelta(self.idle_days)
            self.handle.registerTimer(int(end.timestamp() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.last, self.weights, self.moves):
            state.clear()
        yield from ()

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """From a saved position and weights, as ``saved`` gives them."""
        self._write(Book(initialState["date"], initialState["regime_id"], initialState["ratio"], 1, {w["agent"]: w["weight"] for w in initialState["weights"]}))


def route(stream: DataFrame, settings: Settings, idle_days: int | None = None, saved: DataFrame | None = None) -> DataFrame:
    """DECISIONS from a stream of DAYS. ``saved``: (book, date, regime_id, ratio, weights: array of struct(agent, weight)) to begin with."""
    if idle_days is not None:
        stream = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", "0 days")
    begin = saved.groupBy("book") if saved is not None else None
    return stream.groupBy("book").transformWithState(LiveRouter(settings, idle_days), DECISIONS, "Append", "EventTime" if idle_days is not None else "None", initialState=begin)


def route_all(days: DataFrame, settings: Settings) -> DataFrame:
    """The same decisions for a table of DAYS. A book has a row a day; books spread."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book, out = Book(), []
        for row in pdf.sort_values("date").to_dict("records"):
            book, decided = step(book, row, settings)
            out.append((row["book"], row["date"], *decided, False))
        return pd.DataFrame(out, columns=["book", "date", "regime_id", "candidates", "branches", "weights", "ratio", "late"])

    return days.groupBy("book").applyInPandas(run, DECISIONS)


def replay_parts(parts: Iterable[DataFrame], place: str, settings: Settings, idle_days: int | None = None) -> DataFrame:
    """Appends each part to a folder and runs the stream until it has taken it, from its checkpoint each time; all decisions."""
    spark, schema = None, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        part.write.mode("append").parquet(f"{place}/days")
        provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            decided = route(spark.readStream.schema(schema).parquet(f"{place}/days"), settings, idle_days)
            query = decided.writeStream.format("parquet").option("path", f"{place}/decisions").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.schema(DECISIONS).parquet(f"{place}/decisions")
