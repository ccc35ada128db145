"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from barograph.llm import queries
from barograph.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_only_lose_rows_and_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents")
    names, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.write_shared(stage(spark, docs, FOLDER), f"test-{name}")
        docs = spark.read.parquet(path)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert docs.where("not lossless").count() == 0


def test_stages_take_odd_rows_and_columns(spark):
    from pyspark.sql import functions as F

    docs = table(spark, FOLDER, "documents")
    words = " ".join(f"w{i}x{i * i % 9973}" for i in range(60_000))
    odd = [(None, None), (None, None), (7001, None), (7002, ""), (7003, "..."), (7004, words), (7004, words), (7005, words), (None, "one line of no one")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    clash = {c: F.lit("clash") for c in ("own", "own_id", "digest", "removed", "score", "ranges", "class", "_removed", "row")}
    docs = docs.unionByName(more).withColumns(clash)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(corpus_pipeline.write_shared(stage(spark, docs, FOLDER), f"odd-{name}"))
        if name != "encoding":
            assert docs.columns == names and docs.where("own <> 'clash' or removed <> 'clash'").isEmpty()
    left = docs.where("doc_id is null or doc_id > 7000").collect()
    # Null and empty texts are one class, whose first is 7001; the long text is kept once, and whole.
    assert sorted(((r["doc_id"] or 0), r["lossless"]) for r in left) == [(0, True), (7001, True), (7003, True), (7004, True)]
    assert next(r for r in left if r["doc_id"] == 7004)["n_tokens"] > 100_000
    none = table(spark, FOLDER, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, FOLDER)
        assert out.count() == 0


def test_search_gives_twenty_rows_for_each_item(spark):
    rows = queries.QUERIES["op12_hashed_max_sketches"](spark, FOLDER).groupBy("item_id").count().collect()
    assert len(rows) == table(spark, FOLDER, "benchmark").count() and {r["count"] for r in rows} == {20}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_hashed_max_sketches"}))
def test_queries_give_a_row_for_each(spark, name):
    of = {"op4_chat_formatting": "conversations", "op9_url_filter": "pages"}.get(name, "documents")
    rows = table(spark, FOLDER, of)
    want = rows.select("conv_id").distinct().count() + 1 if of == "conversations" else rows.count()
    assert queries.QUERIES[name](spark, FOLDER).count() == want
