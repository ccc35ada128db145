"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark contamination, encoding.

Each stage reads the Parquet files that the one before wrote to the shared folder, and works on all that it kept. Stages take
tables with further columns, whatever they are called, and keep them; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import decontamination, near_duplicates, piece_dropout, substring_dedup, toxicity
from barograph.sources.tables import discard, table, write_shared


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score THRESHOLD or more; learns from the labels of the folds that are not held out.

    Rows stay as they are, repeated ones and those of a null doc_id too; null, empty and wordless texts score 0 and stay, very
    long ones are scored whole. Without labels of both kinds all rows stay. A score equal to the threshold goes.
    """
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.reject(docs, model)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each class of near duplicates.

    A null doc_id comes last; of equal ids the first row read is kept, so repeated rows become one. Null counts as the empty
    text, and empty or wordless texts are duplicates only if equal. Long texts are compared whole.
    """
    return near_duplicates.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated sentence spans out of the texts; n_chars follows.

    No row goes: a text of which nothing is left is empty. Of equal texts the least doc_id's stays (a null one comes last), and
    rows that agree in doc_id and text stay alike. A null text stays null.
    """
    removed = "removed"
    while removed in docs.columns:
        removed += "_"
    cut = substring_dedup.deduplicate(docs, removed)
    n_chars = F.when(cut[removed].isNull(), cut["n_chars"]).otherwise(F.length(cut["text"]).cast("long"))
    return cut.withColumn("n_chars", n_chars).drop(removed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words a twentieth or more stand in passages of the benchmark.

    Each row is judged by its text alone, whatever its doc_id; null and wordless texts stay. With an empty benchmark all do.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with a check of what they decode to.

    A row for each row; null and empty texts have no ids. Skips depend on doc_id (null is one id) and place, so repeated rows
    have the same ids. Columns beside doc_id and text end here.
    """
    return piece_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), kept=KEPT_NODES)


#: What a worker keeps while it encodes: less than alone, as executors still hold memory of the stages before.
KEPT_NODES = 2_000_000

STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_class),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Near duplicates, the fitted classifier and the ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)  # the stage after it has read all of it
        docs, before = spark.read.parquet(path), path
    return docs
