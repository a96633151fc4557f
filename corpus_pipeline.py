"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes the rows that the one before kept, and its decisions take effect: toxic
documents go, of equal texts the one with the largest doc_id stays, of near copies the
one with the smallest, documents are taken as often as the mix takes them, and what is
left is encoded. Stages are written as Parquet in the shared folder and read again, so a
lost executor costs a stage's tasks and never a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import exactdedup, mixing, pieces, simhash, toxicity
from touchline.llm.common import shared_path, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is trained from the labels of ``sf_dir``."""
    return toxicity.clean(docs, toxicity.trained(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id. The stream reads files: rows of anything else are written first."""
    path = shared_path(spark, "exact")
    docs.write.parquet(path)
    return exactdedup.kept(spark, path)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash.keep_similar(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(spark, docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digest of the text they decode to."""
    return pieces.encoded(docs, pieces.model_bytes(pieces.default_model())).select(
        F.col("id").alias("doc_id"), "ids", "n_tokens", "decoded_sha256", "round_trip"
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A trained model, a stream and a dynamic programme: no SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
