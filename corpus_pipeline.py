"""From raw documents to packed training sequences, in stages that are written and read again one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import catalog, near_dedup, packing, secret_scan, toxicity
from framewright.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below its threshold.

    A score at the threshold goes. Null and empty texts score as a text without known n-grams; repeated rows score alike.
    Other columns aren't looked at and stay as they are; an empty table stays empty."""
    return toxicity.keep_clean(docs, catalog.toxicity_model(docs, spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at 0.8.

    Documents without words (null, empty, blank) are in no group and stay, as do rows without an id; rows that repeat an id
    stay or go together, so exact repeats with one id stay. Of ties the smallest id stays. Only the ids that go are joined: sent
    to the documents where their counted size allows."""
    gone = near_dedup.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(near_dedup.hinted(stored(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by a mark and `n_chars` brought up to date.

    Null texts stay null and keep their `n_chars`; empty ones stay empty; repeated rows are changed alike; spans that overlap are
    replaced as one."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with their ids.

    Null and empty texts are a piece of just the end id; repeated rows are packed each; a long text is cut over sequences; an
    empty table gives no piece."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Learning a classifier, MinHash and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
