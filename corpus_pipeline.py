"""From raw documents to packed training sequences: each stage calls one text operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isovane.llm import language, linedup, mixing, packing, simhash
from isovane.plans.lineage import Stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur before, documents that have text left."""
    return linedup.keep_cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash in the anchor-point covering, exact check, prefix join for what it can't reach."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1,024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language ID, SimHash and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads the stored rows of the one before, so no stage runs twice."""
    docs, between = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stored(spark)
    for _, stage in STAGES[:-1]:
        docs = between.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
