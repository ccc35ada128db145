"""Reading of tables and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one is made, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='barograph-')}")
    return spark.sparkContext.getCheckpointDir()


_WORK: ContextVar[str | None] = ContextVar("work", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside the block are deleted when it ends, unless they are kept."""
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    token = _WORK.set(path)
    try:
        yield
    finally:
        _WORK.reset(token)
        discard(spark, path)


def write_shared(df: DataFrame, name: str, codec: str | None = None, keep: bool = False, by: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as Parquet to a new folder in the shared folder and returns its path; ``keep``: beyond a workspace; ``by``: columns whose values get folders of their own."""
    place = (None if keep else _WORK.get()) or shared_folder(df.sparkSession)
    path = f"{place}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what ``write_shared`` wrote, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, codec: str | None = None, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name, codec, keep))
