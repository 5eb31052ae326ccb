"""The stages of the pipeline: each takes (spark, docs, folder of the tables)
and returns the documents it keeps, the last one the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.llm.common import table
from groundsieve.llm.decontamination import leaks, without_leaks
from groundsieve.llm.line_dedup import deduplicated
from groundsieve.llm.near_duplicates import keep_first
from groundsieve.llm.packing import PackingOptions, pack_documents
from groundsieve.llm.quality import keep_good
from groundsieve.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated lines leave their documents; every document stays, with its new length."""
    return deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return without_leaks(docs, leaks(docs, table(spark, folder, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack_documents(docs, PackingOptions(TOKENIZER))
