"""Merging, normalising, fusing and reranking the candidates of every query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.config import SCORE_DIGITS
from groundsieve.functions import scoring
from groundsieve.operators.topk import ranked

# What runs in the workers travels with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(scoring)

_KEYS = ("query_id",)


def merge_candidates(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Union of both result lists by passage, keeping both scores and ranks."""
    merged = lexical.join(dense, ["query_id", "passage_id"], "full_outer")
    by_lexical, by_dense = F.col("lexical_score").isNotNull(), F.col("dense_score").isNotNull()
    return merged.withColumn("overlap_matched", by_lexical & by_dense).withColumn(
        "source_methods",
        F.array_compact(F.array(F.when(by_lexical, "lexical"), F.when(by_dense, "dense"))),
    )


def normalize_scores(candidates: DataFrame, method: str, by: tuple = _KEYS) -> DataFrame:
    """Min-max of ``<method>_score`` within each query; null stays null, no range gives 0."""
    score, whole = F.col(f"{method}_score"), W.partitionBy(*by)
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    scaled = F.when(high > low, (score - low) / (high - low)).otherwise(0.0)
    return candidates.withColumn(f"{method}_score_normalized", F.when(score.isNotNull(), scaled))


def _setting(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fuse_scores(
    candidates: DataFrame, alpha=0.5, beta=0.5, boost_enabled=False, boost_value=0.05,
    by: tuple = _KEYS,
) -> DataFrame:
    """hybrid_score = alpha * lexical + beta * dense + boost, ranked within each query.

    A missing score counts as 0; only passages found by both methods are
    boosted. The settings may be plain values or columns (one row per setting).
    """
    boost = F.when(_setting(boost_enabled) & F.col("overlap_matched"),
                   _setting(boost_value).cast("double")).otherwise(0.0)
    hybrid = (
        _setting(alpha) * F.coalesce("lexical_score_normalized", F.lit(0.0))
        + _setting(beta) * F.coalesce("dense_score_normalized", F.lit(0.0))
        + F.col("overlap_boost")
    )
    fused = candidates.withColumn("overlap_boost", boost).withColumn(
        "hybrid_score", F.round(hybrid, SCORE_DIGITS))
    return ranked(
        fused, "rank_hybrid", F.desc("hybrid_score"), F.asc_nulls_last("rank_lexical"),
        F.asc_nulls_last("rank_dense"), F.asc("passage_id"), by=by,
    )


def rerank(
    candidates: DataFrame, top_k, pair_scores: DataFrame | None = None,
    compat: Column | bool = False, enabled: Column | bool = True, by: tuple = _KEYS,
    whole_queries: bool = False,
) -> DataFrame:
    """Reorders the first ``top_k`` candidates by an outside score per (query, passage).

    Without ``pair_scores`` (or where not ``enabled``) the hybrid score is the
    rerank score and the order stays. A pair without a score falls back to
    its hybrid score, and so does a NaN, which Spark would sort first; under
    ``compat`` a missing score counts as 0 and a NaN anywhere in a query
    leaves that query in hybrid order with its scores as they came.
    """
    top = candidates.where(F.col("rank_hybrid") < _setting(top_k))
    if pair_scores is None:
        return top.withColumn("rerank_score", F.col("hybrid_score")).withColumn(
            "rank_rerank", F.col("rank_hybrid"))
    scored = top.join(
        pair_scores.select("query_id", "passage_id", F.col("score").cast("double").alias("_pair")),
        ["query_id", "passage_id"], "left")
    outside, quirk = _setting(enabled), _setting(compat)
    broken = F.max(F.isnan(F.coalesce("_pair", F.lit(0.0)))).over(W.partitionBy(*by))
    usable = outside & F.col("_pair").isNotNull() & ~F.isnan("_pair")
    if whole_queries:
        usable = F.min(F.coalesce(usable, F.lit(False))).over(W.partitionBy(*by))
    own = F.when(usable, F.round("_pair", SCORE_DIGITS)).otherwise(F.col("hybrid_score"))
    scored = scored.withColumn("_key", F.when(
        quirk, F.when(outside & ~broken, F.coalesce("_pair", F.lit(0.0))).otherwise(0.0),
    ).otherwise(F.when(outside, own).otherwise(0.0))).withColumn(
        "rerank_score", F.when(quirk & outside, F.col("_pair")).otherwise(own))
    return ranked(scored, "rank_rerank", F.desc("_key"), F.asc("rank_hybrid"), by=by).drop("_pair", "_key")


def score_pairs(candidates: DataFrame, questions: DataFrame, passages: DataFrame, scorer) -> DataFrame:
    """pair_scores from a user scorer: a Pandas UDF or Column function of (question, passage text)."""
    return (
        candidates.select("query_id", "passage_id")
        .join(questions.select("query_id", "normalized_question"), "query_id")
        .join(passages.select("passage_id", "text"), "passage_id")
        .select("query_id", "passage_id",
                scorer(F.col("normalized_question"), F.col("text")).alias("score"))
    )


def score_pairs_in_batches(
    candidates: DataFrame, questions: DataFrame, passages: DataFrame, make_scorer: Callable,
    batch: int = 64,
) -> DataFrame:
    """query_id, passage_id, score and error from a scorer that is dear to make.

    ``make_scorer()`` is called once for each Python worker and returns a function of two
    lists, questions and texts, that gives a list of numbers. Pairs go to it in batches
    of like length. A batch that fails is scored query by query; a query that still
    fails has null scores and the reason of it, and the others are not touched.
    """
    pairs = candidates.select("query_id", "passage_id").join(
        questions.select("query_id", "normalized_question"), "query_id").join(
        passages.select("passage_id", "text"), "passage_id")
    name = f"scorer-{uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scoring.held_scorer(name, make_scorer)
        for rows in batches:
            if rows.num_rows:
                yield scoring.scored_batch(rows, scorer, batch)

    # All pairs of a query in one task, so that what fails is asked once.
    return pairs.repartition("query_id").mapInArrow(
        score, "query_id string, passage_id string, score double, error string")


def count_broken_scores(pair_scores: DataFrame) -> DataFrame:
    """Per query how many outside scores are missing or NaN."""
    bad = F.col("score").isNull() | F.isnan("score")
    return pair_scores.groupBy("query_id").agg(
        F.count("*").alias("n_pairs"), F.count_if(bad).alias("n_broken"))
