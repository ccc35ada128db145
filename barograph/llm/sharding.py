"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents are linked where they share a link key. A round counts each key's members by shard (never their pairs), lets
every linked document ask for the shard in which its keys have most members, and grants as many of the moves from one
shard to another as there are moves back, plus a share of the room left. Documents without a link fill what remains, so
that the shards' row counts are at most one apart at the end. Only DataFrame functions are used.

Nulls: a null doc_id, a repeated doc_id's later rows and rows without a link key count as unlinked. Null texts have no
link. Of equal votes a hash of link and shard decides. Texts are whole, however long; only their hashes move. Empty tables
give empty results. Other columns are kept, whatever they are called; one named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm.ranks import salted_rank
from barograph.sources.tables import materialize

#: Rounds of propagation.
ROUNDS = 3
#: Tables of a row for each two shards are broadcast.
MOST_SHARDS = 1024


def _quotas(wants: DataFrame, room: DataFrame) -> DataFrame:
    """Granted moves for each (from, to): the moves back, and a share of the target's room."""
    back = wants.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("n").alias("back"))
    swaps = wants.join(back, ["shard", "target"], "left").withColumn("swap", F.least("n", F.coalesce("back", F.lit(0))))
    rest = F.col("n") - F.col("swap")
    into = Window.partitionBy("target")
    shares = swaps.join(room.select(F.col("shard").alias("target"), "room"), "target").withColumn("all_rest", F.sum(rest).over(into))
    shares = shares.withColumn("so_far", F.sum(rest).over(into.orderBy("shard")))
    # Differences of rounded-down running shares, so that all of the room is given however many shards ask for it.
    share = lambda n: F.floor(F.col("room") * n / F.greatest("all_rest", F.lit(1)))
    granted = F.when(F.col("all_rest") <= F.col("room"), rest).otherwise(share(F.col("so_far")) - share(F.col("so_far") - rest))
    return shares.select("shard", "target", (F.col("swap") + granted).cast("long").alias("quota"))


def propagate(rows: DataFrame, memberships: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (doc_id, ...) with a column ``shard`` from 0 to shards - 1; ``memberships`` (doc_id, link_key) links them.

    The counts of any two shards differ by at most one. Memberships of unknown documents, and null keys, are ignored.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != "shard"]
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), rows["doc_id"].alias("id"), F.struct(*[rows[c] for c in kept]).alias("own")), "shard-rows")
    total = rows.count()
    cap = [total // shards + (s < total % shards) for s in range(shards)]
    caps = spark.createDataFrame([(s, c) for s, c in enumerate(cap)], "shard int, cap long")

    pairs = memberships.where(F.col("doc_id").isNotNull() & F.col("link_key").isNotNull()).select(F.col("doc_id").alias("id"), "link_key").distinct()
    firsts = rows.where("id is not null").groupBy("id").agg(F.min("row").alias("row"))
    pairs = pairs.join(firsts, "id").select("row", "link_key")
    sizes = pairs.groupBy("link_key").agg(F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    links = materialize(pairs.join(sizes, "link_key"), "shard-links")

    start = salted_rank(links.select("row").distinct().withColumn("all", F.lit(0)), ["all"], ["row"], "rank")
    state = materialize(start.select("row", F.pmod(F.col("rank") - 1, F.lit(shards)).cast("int").alias("shard")), "shard-state")
    for _ in range(rounds):
        load = state.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
        room = caps.join(load, "shard", "left").select("shard", F.greatest(F.col("cap") - F.coalesce("load", F.lit(0)), F.lit(0)).alias("room"))
        # A full shard takes only as many as leave it: members look first at the shards that have room, and at their own.
        votes = links.join(state, "row").groupBy("link_key", "n_members", "shard").agg(F.count(F.lit(1)).alias("votes"))
        votes = votes.join(F.broadcast(room), "shard")
        # A shard that could take a key's other members too comes before those in which the key would stay split.
        holds_all = F.when(F.col("room") >= F.col("n_members") - F.col("votes"), 1.0).otherwise(0.0)
        ballots = votes.groupBy("link_key").agg(F.collect_list(F.struct("shard", (F.col("votes") / F.col("n_members") + holds_all).alias("weight"), "room")).alias("ballot"))
        ballots = materialize(ballots, "ballots")  # so a hot key's side of the join can be split
        asked = links.select("row", "link_key").join(ballots, "link_key").select("row", "link_key", F.explode("ballot").alias("b"))
        asked = asked.groupBy("row", F.col("b.shard").alias("target")).agg(F.sum("b.weight").alias("weight"), F.max("b.room").alias("room"), F.min(F.xxhash64("link_key", "b.shard")).alias("tie"))
        asked = asked.join(state, "row")
        order = F.struct("weight", "tie")
        open_ = F.max_by("target", F.when((F.col("room") > 0) | (F.col("target") == F.col("shard")), order)).alias("open")
        # Who would not move into room asks for the best shard of all, where somebody may make place.
        best = asked.groupBy("row", "shard").agg(open_, F.max_by("target", order).alias("any"))
        best = best.select("row", "shard", F.when(F.col("open") != F.col("shard"), F.col("open")).otherwise(F.col("any")).alias("target"))
        movers = materialize(best.where("target <> shard"), "shard-movers")
        wants = movers.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n"))
        ranked = salted_rank(movers, ["shard", "target"], ["row"], "rank", 8)
        granted = ranked.join(F.broadcast(_quotas(wants, room)), ["shard", "target"]).where("rank <= quota").select("row", F.col("target").alias("to"))
        state = materialize(state.join(granted, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "shard-state")

    taken = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    placed = rows.select("row", "own").join(state, "row", "left")
    free = salted_rank(placed.where("shard is null").drop("shard").withColumn("all", F.lit(0)), ["all"], ["row"], "rank").drop("all")
    ends, end = [], 0
    for s in range(shards):
        end += cap[s] - taken.get(s, 0)
        ends.append((s, end))
    where = F.lit(shards - 1)
    for s, last in reversed(ends):
        where = F.when(F.col("rank") <= last, s).otherwise(where)
    placed = placed.where("shard is not null").select("own", "shard").unionByName(free.select("own", where.cast("int").alias("shard")))
    return placed.select(*[F.col("own")[c].alias(c) for c in kept], "shard")


def slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``: 0, 1, ... gapless within each shard."""
    kept = [c for c in placed.columns if c != "slot"]
    rows = materialize(placed.select(F.monotonically_increasing_id().alias("row"), placed["shard"].alias("of"), F.struct(*[placed[c] for c in kept]).alias("own")), "shard-placed")
    return salted_rank(rows, ["of"], ["row"], "rank").select(*[F.col("own")[c].alias(c) for c in kept], (F.col("rank") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked: documents linked where their texts are equal.

    The law is ``rows``: the shards' counts are at most one apart, however large a group of equal texts is; a group
    that is larger than a shard goes on in others.
    """
    body = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(docs["text"].isNotNull(), F.md5(docs["text"])).alias("link_key"))
    rows = materialize(rows, "shard-docs")
    placed = slots(propagate(rows, rows, shards, rounds))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
