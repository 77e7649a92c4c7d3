"""A corpus pipeline of five stages over documents.

Each stage takes all rows that the one before kept, written as Parquet and read
again, and returns the columns of documents; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, jaccard, packing, quality, queries, tokencount, toxicity
from nearfield.llm.batches import fresh_path, sweep, tables_left, written
from nearfield.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality.quality_filter(docs)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group that shares 0.8 of its five-word shingles."""
    return jaccard.near_duplicate_filter(docs, k=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of each document."""
    counted = tokencount.count_tokens(docs, queries.tokenizer("byte_bpe_50k.json"))
    return packing.pack(written(counted.select("doc_id", "n_tokens"), "lengths"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("packing", pack),
]
#: Toxicity and token counts can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage needed on the way goes with its end."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = tables_left()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            sweep(spark, before)
    return docs
