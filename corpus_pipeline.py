"""A corpus pipeline of the operators: each stage reads what the one before kept.

Language identification, exact copies, near duplicates, benchmark
decontamination, and byte-pair encoding, in this order.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.durable import ensure_checkpoint_dir
from barloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from barloom.llm.common import as_reports, batch_limit, stored, table
from barloom.llm.queries import word_vocabulary

#: Times chance (one over the learned languages) below which no language is accepted: 0.3 for four, 0.6 for two.
LEAST_ODDS = 1.2

#: Pieces in a worker's memory while encoding; five times less than ``bpe.MEMORY``, for the heap of the stages before is still there.
MEMORY = 20_000


def _lean(stage):
    """A stage whose Python workers get small batches: they and the heap live on from stage to stage.

    It writes what its workers return before it ends.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with batch_limit(spark):
            return stage(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with ``row_id``, a number of the row that never changes, in the order of the ids (null last).

    Where every document has an id of its own this is the number; else rows are
    numbered and written once.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn("row_id", F.col("doc_id"))
    place = F.monotonically_increasing_id()
    return stored(
        docs.withColumn("row_id", place)
        .orderBy(F.col("doc_id").asc_nulls_last(), "row_id")
        .withColumn("row_id", place)
    )


def _as(numbered: DataFrame, name: str) -> DataFrame:
    """Numbered documents whose number stands for their id, under ``name``."""
    return numbered.drop("doc_id").withColumnRenamed("row_id", name)


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose row is not among those that go, without the number."""
    gone = stored(gone.toDF("row_id").distinct())
    return numbered.join(gone, "row_id", "left_anti").select([c for c in numbered.columns if c != "row_id"])


def least_score(languages: int) -> float:
    """The least mean probability for so many learned languages; one alone is never open."""
    return LEAST_ODDS / languages if languages > 1 else 0.0


@_lean
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or whose language stays open."""
    docs = _numbered(docs)
    texts = _as(docs, "text_id").select("text_id", "text", "lang")
    network = language_id.train(texts)
    found = language_id.identify(texts, network)
    rejected = found.where(
        (F.col("lang") == language_id.UNKNOWN) | (F.col("score") < least_score(len(network.labels) if network else 0))
    )
    return _without(docs, rejected.select("text_id"))


@_lean
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    docs = _numbered(docs)
    found = exact_dedup.exact_duplicates(as_reports(_as(docs, "doc_id"))).where("NOT kept")
    return _without(docs, found.select("report_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of linked documents."""
    docs = _numbered(docs)
    found = jaccard_join.near_duplicates(as_reports(_as(docs, "doc_id"))).where("report_id <> component_id")
    return _without(docs, found.select("report_id"))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    docs = _numbered(docs)
    found = decontaminate.contained_items(_as(docs, "doc_id"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"))


@_lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and a digest of the text they decode to."""
    encoded = bpe.round_trip(as_reports(docs), word_vocabulary(), memory=MEMORY)
    return stored(
        encoded.select(
            F.col("report_id").alias("doc_id"),
            (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
            "token_ids",
            F.sha2("token_ids", 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_test_items),
    ("bpe", encode),
]

#: Neither the network nor the encoding can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
