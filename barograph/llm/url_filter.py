"""Rules on hosts and path prefixes, matched by short hash prefixes and confirmed by full digests.

A url gives the expressions host suffix + path prefix; a rule gives one. First the suffixes of each distinct host meet the
rules' hosts, which tells the lengths that a path prefix may have there. Then the expressions of these lengths are hashed,
expressions and rules meet on the first bytes of the digest, and the full digests decide. The longest rule that fits wins;
of equal lengths the one of the longer host, then block before allow (two such rules are the same rule). The work is done
once for each (host, path), however many pages share it.

Null urls, and those without ``://``, have an empty host and path and fit only rules of an empty host. Rules with a null in
any column are left out; repeated rules count once. Urls are whole, however long. Repeated pages each give a row, an empty
table gives an empty result, and without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the short hash: 32 bits.
SHORT = 8


def _lower(x: Column) -> Column:
    """A-Z only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host_: Column, path_: Column) -> Column:
    return F.sha2(F.concat(host_, F.lit("\n"), path_), 256)


def _suffixes(host_: Column) -> Column:
    """The host and what follows each of its dots; of an empty host only itself."""
    labels = F.split(host_, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict, from ``rules`` (host, path, verdict).

    One row out for each row in. Columns of pages named like a result are replaced, all others stay.
    """
    rules = rules.select(_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    rules = rules.withColumns({"rule": F.concat("r_host", "r_path"), "r_digest": _digest(F.col("r_host"), F.col("r_path"))}).withColumn("r_short", F.left("r_digest", F.lit(SHORT)))
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).withColumn("h_digest", F.sha2("r_host", 256))
    lengths = lengths.select("h_digest", "lengths", F.left("h_digest", F.lit(SHORT)).alias("h_short"))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(host(pages[url]).alias("host"), path(pages[url]).alias("path"), F.struct(*[pages[c] for c in kept]).alias("own"))
    keys = rows.select("host", "path").distinct()
    suffixes = keys.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    suffixes = suffixes.where((F.col("suffix") != "") | (F.col("host") == "")).withColumn("digest", F.sha2("suffix", 256)).withColumn("short", F.left("digest", F.lit(SHORT)))
    asked = suffixes.join(lengths, F.col("short") == F.col("h_short")).where(F.col("digest") == F.col("h_digest")).select("host", "suffix", "lengths")
    asked = keys.join(asked, "host").select("host", "path", "suffix", F.explode("lengths").alias("chars")).where(F.col("chars") <= F.length("path"))
    asked = asked.withColumn("digest", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("chars")))).withColumn("short", F.left("digest", F.lit(SHORT)))
    hits = asked.join(rules, F.col("short") == F.col("r_short")).where(F.col("digest") == F.col("r_digest"))
    order = F.struct(F.length("rule"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"))
    won = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_verdict"), order).alias("won"))
    out = rows.join(won, ["host", "path"], "left")
    return out.select(*[F.col("own")[c].alias(c) for c in kept], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.r_verdict", F.lit(default)).alias("verdict"))
