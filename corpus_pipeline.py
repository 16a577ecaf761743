"""Cleaning pipeline over ``documents``: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next stage's
``docs``. All but the last return the columns of ``docs``: toxic documents go, one document of each near-duplicate group
stays, documents that hold a benchmark item go, personal data is replaced by its kind, and what is left is packed
into sequences.

The stages inherit the defined cases of their operators: null and empty texts are clean, share one near-duplicate group, hold nothing to
redact and take no room in a sequence; repeated rows are one group; empty tables pass through; extra columns are kept
until packing. Whether a document is toxic is learned from ``labels`` and the documents that reach the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wideprep.llm import decontam, packing, pii, simhash, tokens, toxicity
from wideprep.llm.common import read_table, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: No SQL expresses the learned toxicity grammar; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
