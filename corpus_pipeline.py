"""The corpus pipeline: documents through five training-data operators, one stage after the other.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``; columns
of any other name pass through. Null or empty texts: rejected by the first stage (no language). Repeated rows: one of
them stays after the second stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.decontamination import contamination
from basketry.llm.exchange import written
from basketry.llm.language_id import UNDETERMINED, identify, train
from basketry.llm.near_dedup import near_duplicates
from basketry.llm.packing import default_tokenizer, pack
from basketry.llm.private_data import find_private, redacted

#: A document stays if the belief in its language is at least this; a text of two mixed languages still passes.
LEAST_BELIEF = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language; the model learns from all labelled rows."""
    found = identify(docs, train(docs.select("text", "lang")))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_BELIEF)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, 0.8): the one with the smallest doc_id."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Rows are numbered once and written, so that rows with one doc_id stay apart.
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    members = groups.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    members = members.join(rows.select("number", "row.doc_id"), "number")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias("number")), "number").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of ``benchmark``."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("size(item_ids) = 0").select("row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    found = find_private(docs)
    text = redacted(F.col("row.text").cast("string"), F.col("spans"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left into sequences of 2048 tokens."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("private_data", private_data),
    ("packing", packing),
]

#: The stages learn models and pack sequences, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
