"""Evaluation runs: a question set scored end to end, and experiments over settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundsieve.config import RetrievalConfig
from groundsieve.operators.answers import answer_drafts, verification_reports
from groundsieve.operators.evaluation import (
    classify_failures, evaluate_bundles, failure_histogram, grounding_metrics, stage_ids,
    summarize_model_run, summarize_run,
)
from groundsieve.operators.fusion import fuse_scores, normalize_scores, rerank
from groundsieve.plans.ingest import CorpusIndex
from groundsieve.plans.retrieval import Retrieval, retrieve


@dataclass(frozen=True)
class EvalRun:
    results: DataFrame
    summary: DataFrame


def run_eval(
    items: DataFrame, index: CorpusIndex, config: RetrievalConfig = RetrievalConfig(),
    answers: DataFrame | None = None, reports: DataFrame | None = None,
    pair_scores: DataFrame | None = None, generation: bool = True,
) -> EvalRun:
    """Scores items(query_id, question, expected_ids, ...) in one job.

    ``answers`` and ``reports`` are resolved model outputs; without them the
    deterministic answer and check stand in. ``generation=False`` stops after
    retrieval.
    """
    found = retrieve(items.select("query_id", "question"), index, config, pair_scores=pair_scores)
    results = evaluate_bundles(items, found.bundles, config.compat)
    if generation:
        drafts = answer_drafts(found.bundles, answers)
        checks = verification_reports(drafts, found.bundles, reports)
        grounded = grounding_metrics(drafts, checks, found.bundles, config.compat)
        results = results.join(grounded, "query_id", "left")
    return EvalRun(results, summarize_run(results))


def model_run(
    items: DataFrame, found: Retrieval, label: str, config: RetrievalConfig = RetrievalConfig(),
    answers: DataFrame | None = None, reports: DataFrame | None = None, generation: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-question results, summary and failure histogram of one model run."""
    results = classify_failures(items, stage_ids(found.merged, found.reranked))
    results = results.withColumns({
        "label": F.lit(label), "hybrid_alpha": F.lit(config.hybrid_alpha),
        "hybrid_beta": F.lit(config.hybrid_beta), "error": F.lit(None).cast("string")})
    if generation:
        drafts = answer_drafts(found.bundles, answers)
        checks = verification_reports(drafts, found.bundles, reports)
        step = F.struct("mode", "attempts", "structured_success", "repair_attempted",
                        "repair_succeeded", "failure_reason", "fallback_used")
        results = results.join(drafts.select(
            "query_id", step.alias("answer"), F.substring("final_answer", 1, 240)
            .alias("final_answer_preview"), F.col("error").alias("draft_error")), "query_id", "left")
        results = results.join(checks.select(
            "query_id", step.alias("verifier"), F.col("status").alias("verification_status"),
            F.col("notes").alias("verification_notes")), "query_id", "left")
        bundled = found.bundles.select("query_id", F.lit(True).alias("bundled"))
        results = results.join(bundled, "query_id", "left").withColumn("error", F.coalesce(
            "draft_error", F.when(F.col("bundled").isNull(), "no evidence bundle"))).drop("draft_error", "bundled")
    return (results, summarize_model_run(results, ("label",), generation),
            failure_histogram(results, ("label",)))


def sweep(
    candidates: DataFrame, settings: dict[str, RetrievalConfig],
    pair_scores: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fuses and reranks one candidate table under several labelled settings at once.

    The searches do not depend on the settings, so ``candidates`` (both
    searches merged) is computed once and each row is carried once per
    setting. Returns the fused and the reranked candidates, keyed by label.
    """
    table = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(c.hybrid_alpha).alias("alpha"),
            F.lit(c.hybrid_beta).alias("beta"), F.lit(c.overlap_boost_enabled).alias("boost"),
            F.lit(c.overlap_boost_value).alias("boost_value"),
            F.lit(c.reranker_enabled).alias("reranker"), F.lit(c.reranker_top_k).alias("top_k"),
            F.lit(c.compat).alias("compat"))
        for label, c in settings.items()
    ])
    scaled = normalize_scores(normalize_scores(candidates, "lexical"), "dense")
    rows = scaled.select("*", F.inline(table))
    by = ("label", "query_id")
    fused = fuse_scores(rows, F.col("alpha"), F.col("beta"), F.col("boost"),
                        F.col("boost_value"), by=by)
    return fused, rerank(fused, F.col("top_k"), pair_scores, F.col("compat"), F.col("reranker"), by=by)


def sweep_results(items: DataFrame, fused: DataFrame, reranked: DataFrame,
                  labels: tuple = ()) -> DataFrame:
    """Hits and failure types of every item under every setting. An item
    without candidates has nothing found. ``labels`` names the settings; without
    it they are those that found anything."""
    by = ("label", "query_id")
    ids = stage_ids(fused, reranked, by=by)
    if labels:
        keyed = items.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    else:
        names = ids.agg(F.array_sort(F.collect_set("label")).alias("labels"))  # one row, a name for each setting
        keyed = items.join(F.broadcast(names)).withColumn("label", F.explode("labels")).drop("labels")
    return classify_failures(keyed, ids, by=by)
