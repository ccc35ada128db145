"""A Merkle manifest of a dataset that stores few levels and recomputes the others.

Every row is a leaf. Within each group (a language), leaves in ascending order are hashed by runs of FAN, runs of those
again, until one node is left; the groups' last nodes, in the groups' order, are hashed to the root likewise. Stored are
the leaves and every LEVELS-th level above them, as blocks: a block has the stored nodes below one node of the next
stored level, so an aligned subtree is one row of at most FAN**LEVELS digests, whatever the group's size. A proof
regenerates the levels between from such rows, writes down the siblings on the way and forgets the rest; the upper
blocks' proofs are joined to the lower blocks, not to the leaves.

A digest is the lowercase hex sha256 of the concatenated inputs. A field is ``-`` if null, else its UTF-8 byte count, a
colon and the value, so no two rows give the same input. Nulls come first, as doc_id and as group. Rows of the same doc_id
are ordered by their leaves; equal rows are each a leaf, next to each other. An empty table has no rows and no root. Texts are
whole, however long. Other columns are dropped, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.operators.positions import positions
from barograph.sources.tables import materialize, write_shared

#: Fixed by the contract: children of a node.
FAN = 8
#: Levels from one stored level to the next: a stored block has FAN**LEVELS digests at most.
LEVELS = 3
_BITS = 3  # FAN is 2**_BITS
_SHIFT = _BITS * LEVELS
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**fields: Column) -> Column:
    """The digest of a row; ``fields``: other values for some of its columns."""
    out = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        out.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return sha256(*out)


class Manifest(NamedTuple):
    """Paths of stored blocks, lowest first, of the groups' trees and of the tree over the groups."""

    lower: list[str]
    upper: list[str]


def _run(nodes: Column, at: Column, n: int = FAN) -> Column:
    """The digests of the run from ``at`` (counted from 0), joined."""
    return F.array_join(F.slice(nodes, (at + 1).cast("int"), n), "")


def _up(nodes: Column) -> Column:
    """The next level of a subtree."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, _BITS)), lambda i: F.sha2(_run(nodes, i * FAN), 256))


def _levels(blocks: DataFrame) -> DataFrame:
    """Adds l0, l1, ... : the nodes of a block's subtree level by level, up to the group's last node; n0, n1, ...: how many the group has there."""
    out = blocks.withColumns({"l0": F.transform("nodes", lambda x: x["digest"]), "n0": F.col("n")})
    for k in range(LEVELS):
        more = F.col(f"n{k}") > 1
        out = out.withColumns({f"l{k + 1}": F.when(more, _up(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")), f"n{k + 1}": F.shiftright(F.col(f"n{k}") + FAN - 1, _BITS)})
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, n, at, digest, carried) as one row for each subtree: grp, block, n, nodes in order. n: nodes that the group has."""
    at = F.col("at")
    packed = nodes.groupBy("grp", F.shiftright(at, _SHIFT).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "carried"))).alias("nodes"))
    return packed.select("grp", "block", "n", "nodes")


def _tree(nodes: DataFrame, name: str) -> tuple[list[str], DataFrame]:
    """Writes the blocks of each stored level; returns their paths, and (grp, digest) of the last nodes."""
    spark, paths = nodes.sparkSession, []
    while True:
        paths.append(write_shared(_blocks(nodes), f"merkle-{name}-{LEVELS * len(paths)}", "zstd"))
        stored = spark.read.parquet(paths[-1])
        most = stored.agg(F.max("n")).first()[0] or 0
        top = _levels(stored).select("grp", F.col("block").alias("at"), F.col(f"n{LEVELS}").alias("n"), F.col(f"l{LEVELS}")[0].alias("digest"), F.lit(None).cast("string").alias("carried"))
        if most <= FAN**LEVELS:
            return paths, top.select("grp", "digest")
        nodes = top


def build(docs: DataFrame, group: str = "lang", carried: Column | None = None) -> Manifest:
    """Writes the manifest of ``docs`` (the columns FIELDS). ``carried``: a text that is stored with each leaf."""
    extra = F.lit(None).cast("string") if carried is None else carried
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), extra.alias("extra"))
    placed = positions(leaves, ["doc_id", "digest"], ["grp"], position="at", total="n")
    carry = F.to_json(F.struct("doc_id", "extra")).alias("carried")
    lower, subroots = _tree(placed.select("grp", "n", "at", "digest", carry), "group")
    top = positions(subroots, ["grp"], position="at", total="n")
    upper, _ = _tree(top.select(F.lit("").alias("grp"), "n", "at", "digest", F.col("grp").alias("carried")), "top")
    return Manifest(lower, upper)


def _siblings(blocks: DataFrame) -> DataFrame:
    """A block's nodes, each with its siblings (left, right) on every level up to the next stored one, and the block's last node."""
    expanded = _levels(blocks)

    def of(i: Column) -> Column:
        steps, at = [], i
        for k in range(LEVELS):
            level, run = F.col(f"l{k}"), F.shiftright(at, _BITS)
            place = at - run * FAN
            left, right = F.array_join(F.slice(level, run * FAN + 1, place), ""), F.array_join(F.slice(level, at + 2, F.lit(FAN - 1) - place), "")
            steps.append(F.when(F.col(f"n{k}") > 1, F.struct(left.alias("left"), right.alias("right"))))
            at = run
        return F.filter(F.array(*steps), lambda s: s.isNotNull())

    nodes = F.transform("nodes", lambda x, i: F.struct(x["at"].alias("at"), x["digest"].alias("digest"), x["carried"].alias("carried"), of(i).alias("steps")))
    return expanded.select("grp", "block", nodes.alias("nodes"), F.col(f"l{LEVELS}")[0].alias("last"))


def _proofs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """grp, at, digest, carried, steps, last for the nodes of the lowest level; last: the tree's last node."""
    above = None
    for path in reversed(paths):
        below = _siblings(spark.read.parquet(path))
        if above is not None:
            up = above.select(F.col("grp").alias("_grp"), F.col("at").alias("_block"), F.col("steps").alias("_steps"), F.col("last").alias("_last"))
            below = below.join(up, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))
            more, last = F.col("_steps"), F.col("_last")
        else:
            more, last = F.array().cast("array<struct<left: string, right: string>>"), F.col("last")
        above = below.select("grp", more.alias("more"), last.alias("last"), F.explode_outer("nodes").alias("x"))  # outer: else a filter on the size, pushed below, would compute all levels again
        above = above.select("grp", "x.at", "x.digest", "x.carried", F.concat("x.steps", "more").alias("steps"), "last")
    return above


def proofs(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """doc_id, grp, leaf, carried, subroot, root, proof: the siblings of each leaf up to the root.

    ``proof``: a pair (left, right) of joined digests for each level; both are empty for a run of one.
    """
    tops = _proofs(spark, manifest.upper).select(F.col("carried").alias("_grp"), F.col("digest").alias("subroot"), F.col("steps").alias("_more"), F.col("last").alias("root"))
    # A row for each group; its steps are joined to the blocks' proofs below.
    own = _proofs(spark, manifest.lower).join(tops, F.col("grp").eqNullSafe(F.col("_grp")))
    kept = F.from_json("carried", "doc_id bigint, extra string")
    return own.select(kept["doc_id"].alias("doc_id"), "grp", F.col("digest").alias("leaf"), kept["extra"].alias("carried"), "subroot", "root", F.concat("steps", "_more").alias("proof"))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, digest, lambda acc, s: sha256(s["left"], acc, s["right"]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row of ``docs``, with ``tampered`` as its text, against the manifest of ``docs``."""
    manifest = build(docs, carried=leaf(text=tampered))
    rows = proofs(docs.sparkSession, manifest).withColumn("folded_root", fold(F.col("carried"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
