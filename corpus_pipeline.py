"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``veldra.llm``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept: toxic documents go, one document of each
near-duplicate class stays, documents that hold a benchmark item go, personal data is replaced by ``[KIND]``, and the
texts are segmented. All but the last return the columns of ``documents``. Null texts are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import decontaminate, near_dup, pii, sentencepiece_sampling, toxicity
from veldra.llm.common import stored, table, without
from veldra.llm.queries import crc_class

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; learnt from the labelled rows outside the held-out fold."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_class(4) != 2)
    return docs.where(toxicity.score(field, spans=False)["score"] < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return near_dup.one_of_each(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item; one pass finds them, one leaves them out."""
    found = stored(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return without(docs, found)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All spans replaced by their kind, and n_chars counted anew."""
    found = pii.detect(docs, pii.train(docs), out="__pii")
    text = pii.redact(F.col("text"), F.col("__pii"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids): the sampled segmentation of each text."""
    made = sentencepiece_sampling.encode(docs.select("doc_id", "text"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("sentencepiece", segment),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
