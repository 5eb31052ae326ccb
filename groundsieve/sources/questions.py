"""Reading question sets: JSON arrays of items, with defaults for missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVAL_FIELDS = (
    "id string, question string, mode string, category string, notes string, "
    "expected_relevant_passage_ids array<string>, acceptable_alternative_passage_ids array<string>, "
    "minimum_expected_count int, ambiguity_flag boolean")
QUESTION_FIELDS = (
    "id string, question string, mode string, category string, notes string, "
    "expected_verse_refs array<string>")


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Eval items with their gold ids; absent fields get their defaults."""
    rows = spark.read.schema(EVAL_FIELDS).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("id").alias("query_id"), "question",
        F.coalesce("mode", F.lit("source_only")).alias("mode"),
        F.coalesce("category", F.lit("direct_lookup")).alias("category"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("expected_relevant_passage_ids", none).alias("expected_ids"),
        F.coalesce("acceptable_alternative_passage_ids", none).alias("alternative_ids"),
        F.coalesce("minimum_expected_count", F.lit(1)).alias("minimum_expected_count"),
        F.coalesce("ambiguity_flag", F.lit(False)).alias("ambiguity_flag"),
    )


def read_questions(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Questions with gold unit references; ``first`` keeps that many by id."""
    rows = spark.read.schema(QUESTION_FIELDS).json(path, multiLine=True).select(
        F.col("id").alias("query_id"), "question",
        F.coalesce("mode", F.lit("source_only")).alias("mode"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("expected_verse_refs", F.array().cast("array<string>")).alias("refs"),
    )
    return rows if first is None else rows.orderBy("query_id").limit(first)
