"""The training-data pipeline over the document table; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundsieve.llm import stages
from groundsieve.sources.staging import stage

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("best_fit_packing", stages.best_fit_packing),
]

# Several stages are no SQL: edit joins, sketches, a factorised term matrix, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
