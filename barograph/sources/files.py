"""Sources and sinks at the edge: CSV, JSON lines, key/value tables, daily files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> str:
    """``mode``: as Spark's; ``ignore`` leaves what is there, ``append`` adds files."""
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)
    return path


def scan_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(paths)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the candidates that exists."""
    for p in paths:
        where, fs = _file_system(spark, p)
        if fs.exists(where):
            return p
    raise FileNotFoundError(", ".join(paths))


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Renames ``new`` over ``old`` in one step: a reader finds one or the other."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (new, old))
    how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    where, fs = _file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


#: The file of a published place that names its version.
POINTER = "CURRENT"


def stage(df: DataFrame, place: str) -> str:
    """Writes ``df`` as a new version of ``place`` that no reader sees yet; its name."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{place}/{version}")
    return version


def unstage(spark: SparkSession, place: str, version: str) -> None:
    """Deletes a version that was never pointed to."""
    where, fs = _file_system(spark, f"{place}/{version}")
    fs.delete(where, True)


def point(spark: SparkSession, place: str, version: str) -> str:
    """Makes a staged version the one that readers see, in one step. The version before stays, for those who still read it; older ones go."""
    before = _read_text(spark, f"{place}/{POINTER}")
    _write_text(spark, version, f"{place}/.{POINTER}-{version}")
    _replace(spark, f"{place}/.{POINTER}-{version}", f"{place}/{POINTER}")
    where, fs = _file_system(spark, place)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)
    return place


def publish(df: DataFrame, place: str) -> str:
    """Replaces the table at ``place``: readers see the old one or the whole new one, also after a crash at any point."""
    return point(df.sparkSession, place, stage(df, place))


def published(spark: SparkSession, place: str) -> DataFrame:
    """The table last published at ``place``."""
    version = _read_text(spark, f"{place}/{POINTER}")
    if version is None:
        raise FileNotFoundError(f"nothing is published at {place}")
    return spark.read.parquet(f"{place}/{version}")


def publish_best(df: DataFrame, ranks: DataFrame, by: str, wanted: tuple[str, ...]) -> str:
    """Publishes the rows of the best ``by`` of ``ranks`` (by, is_best) if each of ``wanted`` has as many rows as any; the place.

    Fails, and publishes nothing, where one is missing or incomplete. A row for each of ``wanted`` is all that is collected.
    """
    from barograph.sources.tables import shared_folder

    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [w for w in wanted if counts.get(w, 0) < max(counts.values(), default=1)]
    if short:
        raise ValueError(f"incomplete: {', '.join(short)}")
    best = ranks.where("is_best").first()[by]
    return publish(df.where(F.col(by) == best), f"{shared_folder(df.sparkSession)}/canonical-{uuid.uuid4().hex}")


def write_json_atomic(spark: SparkSession, text: str, path: str) -> str:
    """One small JSON document: written beside its place, then renamed over it in one step."""
    new = f"{path}.{uuid.uuid4().hex}.new"
    _write_text(spark, text, new)
    _replace(spark, new, path)
    return path


def scan_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """A row for each JSON document; one that does not parse gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)


def scan_by_priority(spark: SparkSession, paths: list[str], schema: str, keys: list[str]) -> DataFrame:
    """The tables that exist among ``paths``, merged by ``keys``: a known value of an earlier one wins."""
    from barograph.operators.relational import combine_first

    found = []
    for p in paths:
        where, fs = _file_system(spark, p)
        if fs.exists(where):
            found.append(scan_csv(spark, p, schema))
    if not found:
        raise FileNotFoundError(", ".join(paths))
    out = found[0]
    for more in found[1:]:
        out = combine_first(out, more, keys)
    return out


def scan_recursive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files below ``path``, whatever the folders, with the file each row is from."""
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path).withColumn("file", F.col("_metadata.file_path"))


def name_in_path(pattern: str) -> Column:
    """What the first group of the pattern finds in the file's path."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def scan_kv(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) rows as one wide row; a table that already has the keys as columns gives its first row."""
    if set(keys) <= set(df.columns):
        return df.select(*keys).limit(1)
    return df.groupBy().pivot("key", keys).agg(F.first("value"))


def normalize_date(df: DataFrame) -> DataFrame:
    """The column whose name is ``date`` in any case, parsed; rows that do not parse are left out."""
    name = next(c for c in df.columns if c.lower() == "date")
    out = df.withColumn("_d", F.coalesce(F.expr(f"try_to_date(`{name}`, 'yyyy-MM-dd')"), F.expr(f"try_to_date(`{name}`, 'yyyy/M/d')"))).drop(name)
    return out.withColumnRenamed("_d", "date").where("date is not null")


def suspicious(names: list[str]) -> list[str]:
    """Names that hint at the future."""
    marks = ("label", "target", "future", "_next", "fwd")
    return [n for n in names if any(m in n.lower() for m in marks)]
