"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)). What a stage returns is written as Parquet and read again as the
documents of the next one. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundshift.llm import decontaminate, packing, pii, quality, simhash
from groundshift.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules accept."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("near copies", near_copies), ("benchmark leaks", benchmark_leaks), ("personal data", personal_data),
    ("packing", packed),
]

#: The stages learn weights, hash with XXH64 and call a tokenizer, none of which SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}-{name.replace(' ', '-')}")
    return docs
