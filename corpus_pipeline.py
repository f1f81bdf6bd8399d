"""The corpus pipeline, one operator a stage, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, rules, secrets, simhash
from tidemark.llm.shared import documents
from tidemark.scratch import deleted, new_path, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; null and empty texts among them, ties at a threshold stay, repeated rows are judged alike. No documents stay none."""
    return rules.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id; of repeated rows one. Rows without an id can't be named, and stay. No documents stay none."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; null texts stay null, repeated rows are masked alike. No documents stay none."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order that gives every source its share; null sources are one of their own, null texts have size 0, repeated rows follow one another. No documents stay none."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place in the mix, token ids (unsigned 32-bit, little-endian), their number, and a digest of what they decode to.

    A null text has no ids; repeated rows have a place each. No documents give no rows.
    """
    placed = mixing.positions(docs)
    decoded = bpe.decode_documents(bpe.encode_documents(placed, keep=("position",)), keep=("position",))
    return decoded.select(
        "doc_id",
        "position",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: XXH64 fingerprints and byte-pair encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage makes for itself goes once its result is written, and that once the next has read it."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
