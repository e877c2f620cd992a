"""The numbered queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, clustering, embedding_dedup, language_model, near_dedup, packing, secret_scan, sentence_pieces, token_store, toxicity, vector_codes,
    warc_store, wordpiece,
)
from .common import id_remainder, table, tokenizer_path
from .oracles import ORACLES as TABLE_ORACLES
from .oracles import op10


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether decoding them gives the text back."""
    back = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents")))
    n_pieces = (F.octet_length("ids") / 4).cast("long").alias("n_pieces")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), n_pieces, F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("exact"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the documents of `docs` whose labels may be learned from."""
    labels = table(spark, sf_dir, "labels").where(toxicity.learnable())
    return toxicity.train(docs, labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_and_read(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.write_and_read(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_dedup": op3_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_store": op8_token_store,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}
#: Tokenising, learning and the best cut are beyond SQL; tests hold those queries against brute force.
ORACLES: dict[str, str] = TABLE_ORACLES | {"op10_token_counts": op10(tokenizer_path("byte_bpe_50k.json"))}
