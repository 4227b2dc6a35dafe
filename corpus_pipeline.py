"""The corpus pipeline: stages over documents, each one of the operators.

Every stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.llm import bpe, decontamination, jaccard_join, line_dedup, quality
from areal.llm.common import fold, table
from areal.llm.queries import tokenizer_path
from areal.plans.sizing import checkpoint


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score under one half)."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    described = docs.select("doc_id", quality.features_of(F.col("text")).alias("features"))
    model = quality.fit_labelled(described, labels, "quality")
    return docs.filter(quality.score_of(quality.features_of(F.col("text")), model) >= 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; texts shorten, rows stay."""
    return line_dedup.dedup_lines(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): ids as little-endian unsigned 32-bit numbers; exact: they decode to the text."""
    coded = docs.select("doc_id", "text", bpe.round_trip_of(docs, tokenizer_path()).alias("coded"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        (F.col("coded.text") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
#: The classifier and the tokenizer cannot be said in SQL; the tests hold the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written before the next one reads it, often more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
