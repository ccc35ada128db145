"""The queries on the tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import audio, chat, content_store, decontamination, katz, lexical_search, manifest_sql, merkle_manifest, near_duplicates, piece_dropout, search_sql, sharding, substring_dedup, toxicity, url_filter
from barograph.sources.tables import materialize, table, workspace


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("chars_before"))
    removed = substring_dedup.deduplicate(docs)
    n_spans = F.coalesce(F.size("_removed"), F.lit(0))  # size of null is null under ANSI
    return removed.select("doc_id", "text", n_spans.alias("n_repeated_spans"), (F.col("chars_before") - F.length("text")).alias("removed_chars"))


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op3_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"  # fixed by the contract
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(materialize(chat.format_turns(chat.text_parts(turns)), "formatted"))


def op5_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = content_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return content_store.read_back(spark, store)


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, ["doc_id"])
    held_out = F.coalesce(toxicity.fold() == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op8_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "keep")


#: Fixed values of the contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.match(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(audio.text_as_media(table(spark, sf_dir, "documents")), "media")
    return audio.digests(audio.features(media))


def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with workspace(spark):
        model = katz.train(docs.where(~katz.held_out()))
        scored = katz.score(docs, model)
    tokens = F.lit(model.unigrams.tokens).cast("long")
    return scored.select("doc_id", katz.held_out().alias("held_out"), "n_tokens", "n_known", tokens.alias("train_tokens"), "base_score", "score")


def op12_hashed_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle_manifest.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle_manifest.verify(table(spark, sf_dir, "documents"), tampered)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_merge_dropout, op3_balanced_label_propagation, op4_chat_formatting, op5_content_addressed_store, op6_winnowing_decontamination, op7_multiple_instance_toxicity, op8_bagminhash_near_duplicates, op9_url_filter, op10_audio_features, op11_katz_backoff, op12_hashed_max_sketches, op13_merkle_manifest)}

_OP9 = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
k AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM k JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""

_OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS span FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT row, i, di.k, item_id FROM di JOIN bw ON di.k = bw.k AND array_to_string(w[i:i + di.k - 1], ' ') = span),
n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM h) GROUP BY row),
m AS (SELECT row, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.row = d.row LEFT JOIN m ON m.row = d.row
"""

ORACLES = {"op6_winnowing_decontamination": _OP6, "op9_url_filter": _OP9, "op12_hashed_max_sketches": search_sql.SEARCH, "op13_merkle_manifest": manifest_sql.MANIFEST}
