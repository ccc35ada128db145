"""The live router over many books, day by day and as a batch; late and repeated deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.plans.registry import query, rounded
from barograph.plans.routing_queries import _MORE, Base, base
from barograph.sources.bars import regimes
from barograph.sources.tables import materialize, shared_folder, table
from barograph.streaming import live
from barograph.streaming import router as lr

#: Years of the test tables' days; each is a part that the stream is started for.
_PARTS = ("1994-01-01", "1996-07-01")


def _books(spark: SparkSession, d: str, b: Base) -> DataFrame:
    """A row a day of each line number's book: its agents' ratios of the day, and their scores in the day's regime."""
    items = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("book"), F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("agent"), "l_discount")
    ratios = items.groupBy("book", "date", "agent").agg(F.round(F.avg("l_discount") * 20 - 1, 8).alias("ratio"))
    scored = ratios.join(regimes(spark, d), "date").join(b.edges.select("regime_id", "agent", F.col("ir_shrink").alias("score")), ["regime_id", "agent"], "left")
    return scored.groupBy("book", "date", "regime_id").agg(F.collect_list(F.struct("agent", "ratio", "score")).alias("agents")).select("book", "date", "regime_id", "agents")


def _settings(b: Base) -> lr.Settings:
    return lr.Settings({r["regime_id"]: list(r["allowed"]) for r in b.lists.collect()})  # a row a regime


def _out(decisions: DataFrame) -> DataFrame:
    weights = F.array_join(F.transform("weights", lambda w: F.format_string("%.5f", w)), "|")
    return rounded(decisions.where("NOT late").select("book", "date", "regime_id", F.array_join("candidates", "|").alias("candidates"), F.array_join("branches", "|").alias("branches"), weights.alias("weights"), "ratio"), "ratio")


_LIVE = f"""{_MORE},
  ratios AS (SELECT CAST(l_linenumber AS VARCHAR) AS book, CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS agent, round(avg(l_discount) * 20 - 1, 8) AS ratio FROM lineitem GROUP BY 1, 2, 3),
  names AS (SELECT list(agent ORDER BY agent) AS every FROM (SELECT DISTINCT agent FROM ratios)),
  bd AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) AS i FROM (
    SELECT book, date, regime_id, list(agent ORDER BY agent) AS a, list(ratio ORDER BY agent) AS x, list(ir_shrink ORDER BY agent) AS s FROM ratios JOIN regimes USING (date) LEFT JOIN edges USING (regime_id, agent) GROUP BY 1, 2, 3)),
  mv AS (SELECT book, i, lag(regime_id) OVER (PARTITION BY book ORDER BY i) AS p, regime_id AS nx FROM bd),
  cn AS (SELECT d.book, d.i, mv.nx, count(*) AS n, min(mv.i) AS since FROM bd d JOIN bd y ON y.book = d.book AND y.i = d.i - 1 JOIN mv ON mv.book = d.book AND mv.i < d.i AND mv.p = y.regime_id GROUP BY 1, 2, 3),
  cd AS (SELECT book, i, list(nx ORDER BY n DESC, since)[1:2] AS c FROM cn GROUP BY 1, 2),
  safe AS (SELECT allowed AS sa FROM lists WHERE regime_id = -1),
  st AS (SELECT bd.*, CASE WHEN bd.i = 1 THEN CAST([] AS INTEGER[]) ELSE coalesce(cd.c, [y.regime_id]) END AS c FROM bd LEFT JOIN cd ON cd.book = bd.book AND cd.i = bd.i LEFT JOIN bd y ON y.book = bd.book AND y.i = bd.i - 1),
  al AS (SELECT st.book, st.i, list_distinct(flatten(list(allowed))) AS more FROM st JOIN lists ON list_contains(st.c, lists.regime_id) GROUP BY 1, 2),
  f1 AS (SELECT st.*, sa, list_filter(st.a, lambda x: list_contains(sa, x) OR coalesce(list_contains(al.more, x), false)) AS f FROM st CROSS JOIN safe LEFT JOIN al ON al.book = st.book AND al.i = st.i),
  f2 AS (SELECT f1.* EXCLUDE (f), CASE WHEN len(f) > 0 THEN f ELSE a END AS f, coalesce(l.allowed, sa) AS own FROM f1 LEFT JOIN lists l ON l.regime_id = f1.regime_id),
  f3 AS (SELECT *, CASE WHEN len(list_filter(own, lambda x: list_contains(f, x))) > 0 THEN list_filter(own, lambda x: list_contains(f, x)) ELSE f END AS br FROM f2),
  f4 AS (SELECT *, list_transform(br, lambda x: s[list_position(a, x)]) AS bs, list_transform(br, lambda x: coalesce(x2[list_position(a, x)], 0)) AS bx FROM (SELECT *, x AS x2 FROM f3)),
  f5 AS (SELECT *, CASE WHEN len(list_filter(bs, lambda v: v IS NULL)) > 0 THEN list_transform(bs, lambda v: 1 / len(bs)) ELSE list_transform(bs, lambda v: exp(5.0 * (v - list_max(bs))) / list_sum(list_transform(bs, lambda u: exp(5.0 * (u - list_max(bs)))))) END AS raw FROM f4),
  f6 AS (SELECT book, i, date, regime_id, c, br, bx, list_transform(every, lambda n: CASE WHEN list_contains(br, n) THEN raw[list_position(br, n)] END) AS w0, every FROM f5 CROSS JOIN names),
  sim AS (
    SELECT book, i, list_transform(w0, lambda v: v / list_sum(w0)) AS w FROM f6 WHERE i = 1
    UNION ALL
    SELECT book, i, list_transform(m, lambda v: v / list_sum(m)) AS w FROM (
      SELECT f6.book, f6.i, list_transform(f6.every, lambda n: 0.3 * f6.w0[list_position(f6.every, n)] + 0.7 * coalesce(sim.w[list_position(f6.every, n)], 0)) AS m FROM sim JOIN f6 ON f6.book = sim.book AND f6.i = sim.i + 1)),
  dec AS (SELECT f6.*, list_transform(br, lambda n: w[list_position(every, n)]) AS bw FROM f6 JOIN sim USING (book, i))"""
_SELECT = """SELECT book, date, CAST(regime_id AS INTEGER) AS regime_id, array_to_string(c, '|') AS candidates, array_to_string(br, '|') AS branches, array_to_string(list_transform(bw, lambda v: printf('%.5f', v)), '|') AS weights,
  round(greatest(-1, least(1, list_sum(list_transform(range(1, len(bw) + 1), lambda k: bw[k] * bx[k])))), 6) + 0.0 AS ratio FROM dec"""


@query(_SELECT, uses=("experts", "regimes"), more=_LIVE, recursive=True)
def seq_live_router(spark: SparkSession, d: str) -> DataFrame:
    """Days arrive in parts; for each the stream starts from its checkpoint, takes them and stops."""
    b = base(spark, d)
    days = materialize(_books(spark, d, b), "books")
    edges = ["0001-01-01", *_PARTS, "9999-12-31"]
    parts = [days.where((F.col("date") >= F.lit(x).cast("date")) & (F.col("date") < F.lit(y).cast("date"))) for x, y in zip(edges, edges[1:], strict=False)]
    return _out(lr.replay_parts(parts, f"{shared_folder(spark)}/router-{uuid.uuid4().hex}", _settings(b)))


@query(_SELECT, uses=("experts", "regimes"), more=_LIVE, recursive=True)
def seq_live_router_batch(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    return _out(lr.route_all(_books(spark, d, b), _settings(b)))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'too late', count(*) FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)", uses=())
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events in three deliveries, in order of time and each twice; the first day's come again with the last, too late by far."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    days = [r["day"] for r in events.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]  # a row a day
    edges = [days[0], days[len(days) // 3], days[2 * len(days) // 3]]
    day = F.to_date("ts")
    part = lambda i: events.where(day >= F.lit(edges[i])) if i == 2 else events.where((day >= F.lit(edges[i])) & (day < F.lit(edges[i + 1])))
    parts = [part(i).unionByName(part(i)) for i in range(3)]
    parts[2] = parts[2].unionByName(events.where(day == F.lit(days[0])))
    got = live.deliver(parts, lambda s: live.first_of_each(s, ["event_id"], "2 hours"))
    late = spark.createDataFrame([("too late", got.dropped)], "event_type string, n bigint")
    return got.rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).unionByName(late)
