"""What the registered queries share: documents and questions from the driver's
tables, and one index per table folder, built once per Spark application."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.config import RetrievalConfig
from groundsieve.functions.text import blank_tokens, lexical_tokens, normalize_text
from groundsieve.operators.evaluation import gather_ids, locate_quotes
from groundsieve.plans.ingest import CorpusIndex, build_index, ingest
from groundsieve.plans.retrieval import Candidates, Retrieval, assemble, search
from groundsieve.sources.corpus import as_documents
from groundsieve.sources.staging import sent, spread, stage


@dataclass
class Prepared:
    """An index with its questions; candidates and gold are made when first asked for."""

    index: CorpusIndex
    questions: DataFrame

    @cached_property
    def candidates(self) -> Candidates:
        return search(self.questions, self.index)

    @cached_property
    def gold(self) -> DataFrame:
        return stage(gather_ids(locate_quotes(self.index.passages, quotes(self.questions))), "gold")


_prepared: dict[tuple, Prepared] = {}
_runs: dict[tuple, Retrieval] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, text: Column | None = None,
              sectioning: str = "paragraph", passages: str = "natural_units") -> DataFrame:
    """The document table, each text split one passage per line unless told otherwise."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    if text is not None:
        rows = rows.withColumn("text", text)
    return as_documents(rows, sectioning=sectioning, passages=passages)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))


def quotes(asked: DataFrame) -> DataFrame:
    """Every line of every question; one or two words are no quote."""
    lines = F.array_distinct(F.split(normalize_text(F.col("question")), "\n"))
    return asked.select("query_id", F.explode(lines).alias("quote")).where(
        F.size(blank_tokens(F.col("quote"))) >= 3)


def prepared(spark: SparkSession, folder: str, compat: bool = False) -> Prepared:
    key = (spark.sparkContext.applicationId, folder, compat)
    if key not in _prepared:
        config = RetrievalConfig(compat=compat)
        index = build_index(ingest(documents(spark, folder), config).passages, config)
        _prepared[key] = Prepared(index, questions(spark, folder))
    return _prepared[key]


def found(spark: SparkSession, folder: str, with_pairs: bool = False) -> Retrieval:
    """The retrieval run over the benchmark questions, with or without outside
    pair scores; both start from the same searched candidates."""
    key = (spark.sparkContext.applicationId, folder, with_pairs)
    if key not in _runs:
        base = prepared(spark, folder)
        pairs = pair_scores(base) if with_pairs else None
        _runs[key] = assemble(base.candidates, base.index, RetrievalConfig(), pairs)
    return _runs[key]


def pair_scores(base: Prepared) -> DataFrame:
    """Stand-in for an outside reranker: the share of a question's terms that
    the passage holds. First passages of a document get NaN and second ones
    none, as a failing model would give."""
    asked = base.candidates.questions.select(
        "query_id", F.array_distinct("normalized_tokens").alias("wanted"))
    wanted = base.candidates.merged.select("query_id", "passage_id")
    # The passages are scanned where they lie; only the pairs travel.
    pairs = base.index.passages.select("passage_id", "passage_index", "normalized_text").join(
        sent(wanted), "passage_id").join(asked, "query_id")
    tokens = lexical_tokens(F.col("normalized_text"))
    share = F.size(F.array_intersect("wanted", tokens)) / F.greatest(F.size("wanted"), F.lit(1))
    return pairs.where("passage_index <> 1").select(
        "query_id", "passage_id",
        F.when(F.col("passage_index") == 0, F.lit(float("nan"))).otherwise(share).alias("score"))


def eval_items(base: Prepared) -> DataFrame:
    none = F.array().cast("array<string>")
    return base.questions.join(base.gold, "query_id", "left").withColumn(
        "expected_ids", F.coalesce("expected_ids", none))
