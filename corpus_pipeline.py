"""From raw documents to packed sequences: five stages, each one operator of ``lattica.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.cluster import Scratch, scratch_dropped
from lattica.llm.exact_dedup import drop_exact_duplicates
from lattica.llm.mixing import mix_sources
from lattica.llm.near_dup import drop_near_duplicates
from lattica.llm.packing import pack_documents
from lattica.llm.quality_rules import keep_by_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_by_rules(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The shingle sketches, the Poisson draws and the tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, stored. What a stage kept, and all that it left in the shared folder, is dropped when the next one's rows are stored."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES:
        with scratch_dropped():
            docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs
