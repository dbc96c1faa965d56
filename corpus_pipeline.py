"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. What a stage returns is stored and read
again, so no later stage or lost executor makes an earlier one run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscape.llm.jaccard import near_duplicate_stage
from callscape.llm.packing import packing_stage
from callscape.llm.pii import personal_data_stage
from callscape.llm.quality import quality_stage
from callscape.llm.shared import materialize
from callscape.llm.substrings import substring_stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_stage(spark, docs, sf_dir)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_stage(spark, docs, sf_dir)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data_stage(spark, docs, sf_dir)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_stage(spark, docs, sf_dir)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the stages; they are tested against brute force (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
