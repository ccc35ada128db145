"""Structured Streaming: replays of a live day. Sources are files, so a run can be repeated.

What is kept between batches is Spark's own state in the checkpoint folder. A batch writes a folder of its own, named by
its number, so one that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from barograph.sources.tables import shared_folder


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet files that match folder/name as a stream, one file a trigger."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}*")
    # Watermarks need times with a zone.
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def spread(spark: SparkSession, folder: str, name: str, ts: str) -> str:
    """The time that the table's rows span, as an interval. A replay with this delay takes every row, in whatever order of
    time its files come."""
    ends = spark.read.parquet(f"{folder}/{name}").agg(F.min(F.col(ts).cast("timestamp")).alias("a"), F.max(F.col(ts).cast("timestamp")).alias("b")).first()
    return f"{int((ends['b'] - ends['a']).total_seconds()) + 1 if ends['a'] else 1} seconds"


def _place(stream: DataFrame) -> str:
    return f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"


def run_updates(stream: DataFrame) -> DataFrame:
    """Runs the query over all that is there: the rows that each batch updated, with its number in ``batch``."""
    place = _place(stream)

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/updates/batch={n}")

    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{place}/updates/batch=-1")  # a stream may be empty
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = StructType([*stream.schema.fields]).add("batch", LongType())
    return stream.sparkSession.read.schema(schema).parquet(f"{place}/updates")


def last_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's whole output as a table in the shared folder."""
    place = _place(stream)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window; later rows than ``late`` are left out."""
    w = F.window("ts", width)
    counts = stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def last_ticks(ticks: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys and ``value``: that of the greatest ``order`` so far."""
    return ticks.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("last")).select(*keys, F.col(f"last.{value}").alias("value"))


def first_of_each(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """One row of each key within the watermark: idempotent deliveries."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Delivered(NamedTuple):
    """``rows``: what the stream gave; ``dropped``: rows that came behind the watermark; ``kept``: keys in the state at the end."""

    rows: DataFrame
    dropped: int
    kept: int


def deliver(parts: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame]) -> Delivered:
    """Appends each part to a folder, in order of time, and runs ``plan`` on the stream of its files until it has taken it; each run
    starts from the checkpoint of the one before. The watermark keeps its bound, so rows that come too late are dropped and counted."""
    place = spark = schema = out = None
    dropped = kept = 0
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        place = place or _place(part)
        part.write.mode("append").parquet(f"{place}/in")
        stream = plan(spark.readStream.schema(schema).parquet(f"{place}/in"))
        out = stream.schema
        query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            for operator in progress.stateOperators:
                dropped += operator.numRowsDroppedByWatermark
                kept = operator.numRowsTotal
    if place is None:
        raise ValueError("nothing to deliver")
    return Delivered(spark.read.schema(out).parquet(f"{place}/out"), dropped, kept)
