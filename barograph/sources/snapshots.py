"""Daily snapshots: a file for each kind and date, and a manifest that is written when all of them are.

Rows of a kind and date stream into one Parquet file by the task that has them. The commit writes the manifest, which names every
file and its rows, and then points the place to the new set; a failed job leaves what it wrote to be deleted, and the
old set readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from barograph.sources.paths import file_system

FORMAT = "daily_snapshots"
MANIFEST, POINTER = "manifest.jsonl", "CURRENT"
#: What a row must have besides its own columns: which file it goes to, and its place there.
KEYS = ("kind", "date", "seq")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict[str, Any]]


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.place, self.version = options["path"].rstrip("/"), f"v-{uuid.uuid4().hex}"
        self.columns = json.loads(options.get("columns", "{}"))

    def _at(self, name: str) -> tuple[pafs.FileSystem, str]:
        return file_system(f"{self.place}/{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come sorted by kind and date; a new file begins with each."""
        done, key, out, entry = [], None, None, {}
        try:
            for batch in iterator:
                keys = list(zip(batch.column("kind").to_pylist(), batch.column("date").to_pylist(), strict=True))
                begin = 0
                while begin < len(keys):
                    end = begin + 1
                    while end < len(keys) and keys[end] == keys[begin]:
                        end += 1
                    if keys[begin] != key:
                        if out is not None:
                            out.close()
                        key = keys[begin]
                        name = f"{self.version}/{key[0]}/{key[1]}-{uuid.uuid4().hex[:8]}.parquet"
                        fs, path = self._at(name)
                        fs.create_dir(path.rsplit("/", 1)[0])
                        columns = self.columns.get(key[0]) or [c for c in batch.schema.names if c not in KEYS]
                        out = pq.ParquetWriter(path, pa.schema([batch.schema.field(c) for c in columns]), filesystem=fs)
                        entry = {"kind": key[0], "date": str(key[1]), "file": name.split("/", 1)[1], "rows": 0}
                        done.append(entry)
                    out.write_batch(batch.slice(begin, end - begin).select(columns))
                    entry["rows"] += end - begin
                    begin = end
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        entries = sorted((e for m in messages if m for e in m.files), key=lambda e: (e["kind"], e["date"], e["file"]))
        self._text(f"{self.version}/{MANIFEST}", "".join(json.dumps(e) + "\n" for e in entries))
        self._text(f".{POINTER}-{self.version}", self.version)
        fs, new = self._at(f".{POINTER}-{self.version}")
        fs.move(new, self._at(POINTER)[1])  # replaces the old pointer in one step

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = self._at(self.version)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)

    def _text(self, name: str, text: str) -> None:
        fs, path = self._at(name)
        fs.create_dir(path.rsplit("/", 1)[0])
        with fs.open_output_stream(path) as f:
            f.write(text.encode())


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(schema, dict(self.options))


def write(rows: DataFrame, place: str, columns: dict[str, list[str]] | None = None) -> None:
    """Writes rows (KEYS and others) as the new set of ``place``. ``columns``: those that a kind's files have, all others unless given."""
    spark = rows.sparkSession
    spark.dataSource.register(SnapshotSource)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "kind", "date").sortWithinPartitions("kind", "date", "seq")
    dealt.write.format(FORMAT).option("path", place).option("columns", json.dumps(columns or {})).mode("append").save()


def manifest(spark: SparkSession, place: str) -> DataFrame:
    """kind, date, file, rows of the set that ``place`` points to; empty before the first."""
    schema = "kind string, date date, file string, rows bigint"
    version = _version(spark, place)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{place}/{version}/{MANIFEST}")


def _version(spark: SparkSession, place: str) -> str | None:
    from barograph.sources.files import _read_text

    return _read_text(spark, f"{place}/{POINTER}")


def read(spark: SparkSession, place: str, kind: str, schema: str) -> DataFrame:
    """All rows of one kind, with their snapshot's date in ``snapshot``."""
    version = _version(spark, place)
    if version is None:
        return spark.createDataFrame([], f"{schema}, snapshot date")
    name = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d\d-\d\d)-[0-9a-f]{8}\.parquet$", 1)
    return spark.read.schema(schema).parquet(f"{place}/{version}/{kind}").withColumn("snapshot", name.cast("date"))


def daily_sets(df: DataFrame, prices: list[str], features: list[str], calendar: DataFrame, periodic: dict[str, Column], lookback: int = 30, months: int = 3) -> DataFrame:
    """Rows of the kinds prices, features, window (the last ``lookback`` rows up to the date) and future (periodic columns of the
    sessions after it, ``months`` ahead), of each symbol and date.

    ``df``: symbol, date, ``prices``, ``features``; ``calendar``: date of each session; ``periodic``: columns from ``at``, a row's own date.
    """
    from pyspark.sql import Window

    own = [*prices, *features]
    nothing = lambda names: {c: F.lit(None).cast(df.schema[c].dataType) for c in names}
    placed = df.select("symbol", F.col("date").alias("at"), *own, F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("_row"))
    one = lambda kind, drop: placed.withColumns({"kind": F.lit(kind), "date": F.col("at"), "seq": F.lit(0).cast("long")} | nothing(drop))
    dates = placed.select("symbol", F.col("at").alias("date"), F.col("_row").alias("_of"))
    window = placed.withColumn("_of", F.explode(F.sequence(F.col("_row"), F.col("_row") + lookback - 1))).join(dates, ["symbol", "_of"])
    window = window.withColumns({"kind": F.lit("window"), "seq": (F.col("_row") - F.col("_of")).cast("long")})
    # A date is matched with sessions of its own month and the few after it.
    month = lambda c: F.year(c) * 12 + F.month(c)
    ahead = placed.select(F.col("at").alias("date")).distinct().withColumn("_m", F.explode(F.sequence(month("date"), month("date") + months)))
    later = ahead.join(calendar.select(F.col("date").alias("at")).distinct().withColumn("_m", month("at")), "_m").where((F.col("at") > F.col("date")) & (F.col("at") <= F.add_months("date", months)))
    future = later.withColumns({"kind": F.lit("future"), "symbol": F.lit(None).cast("string"), "seq": F.datediff("at", "date").cast("long")} | nothing(own))
    columns = [*KEYS, "symbol", "at", *own]
    all_rows = one("prices", features).select(columns).unionByName(one("features", prices).select(columns)).unionByName(window.select(columns)).unionByName(future.select(columns))
    return all_rows.withColumns(periodic)
