"""Saving and loading: projects, corpus indexes, run artifacts, evaluation results.

Every sink is written by runs (see ``commits``): a retried write replaces the one before
it, a killed one is never read, and an index of five tables changes as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.config import HASH_DIMS
from groundsieve.operators.lexical import LexicalIndex
from groundsieve.plans.ingest import CorpusIndex
from groundsieve.sources.commits import read_runs, write_run, write_runs

_INDEX_TABLES = ("passages", "passage_terms", "term_stats", "corpus_stats", "vectors")
_PROJECT = "project_id"


def _fresh() -> str:
    return f"run-{uuid.uuid4().hex}"


def save_documents(documents: DataFrame, path: str, project_id: str) -> None:
    """The documents of a project; saving again replaces them."""
    write_run({"documents": documents}, path, project_id, _PROJECT)


def save_projects(documents: DataFrame, path: str) -> None:
    """The documents of many projects, named by their project_id, in one write; each project that has
    a document here is replaced."""
    write_runs(documents, path, "documents", _PROJECT)


def load_documents(spark: SparkSession, path: str, projects: DataFrame | None = None) -> DataFrame:
    """The documents of all projects, or of those in the only column of ``projects``; only
    their partitions are read."""
    return read_runs(spark, path, "documents", key=_PROJECT, runs=projects)


def save_index(index: CorpusIndex, path: str, project_id: str) -> None:
    """One parquet table per part, partitioned by project; saving again replaces the project,
    all tables at once."""
    parts = (index.passages, index.lexical.passage_terms, index.lexical.term_stats,
             index.lexical.corpus_stats, index.vectors)
    write_run(dict(zip(_INDEX_TABLES, parts)), path, project_id, _PROJECT)


def load_index(spark: SparkSession, path: str, project_id: str, hashed: bool = True,
               dims: int = HASH_DIMS) -> CorpusIndex:
    """The index of one project; the filter on the partition column reads its files only."""
    passages, terms, stats, corpus, vectors = (
        read_runs(spark, path, name, project_id, _PROJECT).drop(_PROJECT) for name in _INDEX_TABLES)
    return CorpusIndex(passages, LexicalIndex(terms, stats, corpus), vectors, hashed, dims)


def load_passages(spark: SparkSession, path: str, projects: DataFrame | None = None) -> DataFrame:
    """The passages of several projects, with their project_id."""
    return read_runs(spark, path, "passages", key=_PROJECT, runs=projects)


def save_candidates(reranked: DataFrame, path: str, run: str | None = None) -> None:
    """Ranked candidates with all their scores. A named ``run`` that is saved again replaces
    its rows; without a name every call adds."""
    score = F.when(F.coalesce("rerank_score", F.lit(0.0)) != 0, F.col("rerank_score")).otherwise(
        F.col("hybrid_score"))
    rows = reranked.withColumns({
        "retrieval_method": F.lit("hybrid_reranked"), "raw_score": score,
        "rank": F.col("rank_rerank"),
    })
    write_run({"candidates": rows}, path, run or _fresh())


def read_candidates(spark: SparkSession, path: str, query_id: str | None = None,
                    run: str | None = None) -> DataFrame:
    """Stored candidates in rank order, of one query or of all."""
    rows = read_runs(spark, path, "candidates", run)
    if query_id is not None:
        rows = rows.where(F.col("query_id") == query_id)
    return rows.orderBy("query_id", "rank")


def save_artifact(rows: DataFrame, path: str, kind: str, run: str | None = None) -> None:
    """A stage table (bundles, debug, drafts, reports) with the time it was made; runs as
    in ``save_candidates``."""
    made = rows.withColumn("created_at", F.current_timestamp())
    write_run({kind: made}, f"{path}/{kind}", run or _fresh())


def read_artifact(spark: SparkSession, path: str, kind: str, run: str | None = None) -> DataFrame:
    return read_runs(spark, f"{path}/{kind}", kind, run)


def save_results(rows: DataFrame, path: str, label: str) -> None:
    """Evaluation results as JSON under the label of their run; a label that is saved again
    replaces its rows."""
    write_run({"results": rows}, path, label, "label", "json")


def read_results(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    return read_runs(spark, path, "results", label, "label", form="json")
