"""Ready markers as a stream: each day comes once, when its marker says READY, however often it is written or how late.

Markers are files ``name.STATUS.json`` with day, hash and status. Reading a folder gives no order that lasts, so the source
numbers markers as it first sees them and writes that journal down beside the checkpoint; offsets are numbers in it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from barograph.sources.paths import file_system

FORMAT = "ready_markers"
SCHEMA = "seq bigint, day date, hash string, payload string"
READY = "READY"


def _read(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def write_marker(folder: str, name: str, status: str, day: str, digest: str) -> None:
    """Writes a marker beside its place and moves it there; other states of the same name go."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    new = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps({"name": name, "status": status, "day": day, "hash": digest}).encode())
    fs.move(new, f"{path}/{name}.{status}.json")
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.startswith(f"{name}.") and info.base_name != f"{name}.{status}.json":
            fs.delete_file(info.path)


class Part(InputPartition):
    def __init__(self, entries: list[dict[str, Any]]) -> None:
        self.entries = entries


class MarkerReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.journal = options["path"], options["journal"]

    def _known(self) -> list[dict[str, Any]]:
        fs, path = file_system(self.journal)
        if fs.get_file_info(f"{path}/journal.json").type == pafs.FileType.NotFound:
            return []
        return [json.loads(x) for x in _read(fs, f"{path}/journal.json").splitlines()]

    def initialOffset(self) -> dict[str, int]:
        return {"seq": 0}

    def latestOffset(self) -> dict[str, int]:
        """Takes down markers that are new. One that cannot be read, or is not READY, waits; no other day does."""
        known = self._known()
        keys, fresh = {(e["day"], e["hash"]) for e in known}, []
        fs, path = file_system(self.folder)
        for info in sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name):
            if not info.base_name.endswith(f".{READY}.json") or info.base_name.startswith("."):
                continue
            try:
                text = _read(fs, info.path)
                marker = json.loads(text)
                key = marker["day"], marker["hash"]
            except (OSError, ValueError, KeyError, TypeError):
                continue
            if key not in keys:
                keys.add(key)
                fresh.append({"day": key[0], "hash": key[1], "payload": text})
        if fresh:
            known += fresh
            to, place = file_system(self.journal)
            to.create_dir(place, recursive=True)
            with to.open_output_stream(f"{place}/.journal-new") as f:
                f.write("".join(json.dumps(e) + "\n" for e in known).encode())
            to.move(f"{place}/.journal-new", f"{place}/journal.json")
        return {"seq": len(known)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        entries = self._known()[start["seq"] : end["seq"]]
        return [Part([{"seq": start["seq"] + i, **e} for i, e in enumerate(entries)])]  # a row for each day

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        for e in partition.entries:
            yield e["seq"], datetime.date.fromisoformat(e["day"]), e["hash"], e["payload"]

    def commit(self, end: dict[str, int]) -> None:
        """Nothing to give up: the journal says what was taken."""


class MarkerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> MarkerReader:
        return MarkerReader(dict(self.options))


def ready_days(spark: SparkSession, folder: str, journal: str) -> DataFrame:
    """SCHEMA and key (day:hash) as a stream. A day comes again only with another hash."""
    spark.dataSource.register(MarkerSource)
    return spark.readStream.format(FORMAT).option("path", folder).option("journal", journal).load().withColumn("key", F.concat_ws(":", F.col("day").cast("string"), "hash"))
