"""A corpus pipeline of five stages, each written out and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from castellan.llm import exact_dedup, packing, pii, quality, simhash
from castellan.llm.common import ensure_checkpoint_dir, remove
from castellan.llm.queries import VOCABULARY, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document and host rules."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is 0.8 similar in shingles of five words."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their length anew."""
    from pyspark.sql import functions as F

    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences."""
    return packing.pack_documents(docs, vocabulary(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through the shared checkpoint folder, and goes when the next one is written."""
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}")
            docs = spark.read.parquet(f"{root}/{k}")
            if k:
                remove(spark, f"{root}/{k - 1}")
    return docs
