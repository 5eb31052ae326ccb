"""The nine retrieval stages for a whole table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.config import RetrievalConfig
from groundsieve.operators.dense import dense_search, embed_questions
from groundsieve.operators.evidence import evidence_bundles, expand_context, take_anchors
from groundsieve.operators.fusion import fuse_scores, merge_candidates, normalize_scores, rerank
from groundsieve.operators.lexical import bm25_search, prepare_questions
from groundsieve.plans.ingest import CorpusIndex
from groundsieve.sources.staging import stage


@dataclass(frozen=True)
class Candidates:
    """Prepared questions and the merged hits of both searches."""

    questions: DataFrame
    merged: DataFrame

    @property
    def lexical(self) -> DataFrame:
        return self._hits("lexical")

    @property
    def dense(self) -> DataFrame:
        return self._hits("dense")

    def _hits(self, method: str) -> DataFrame:
        score, rank = f"{method}_score", f"rank_{method}"
        return self.merged.where(F.col(score).isNotNull()).select(
            "query_id", "passage_id", score, rank)


@dataclass(frozen=True)
class Retrieval:
    """Every later stage as a DataFrame keyed by query_id."""

    candidates: Candidates
    merged: DataFrame
    reranked: DataFrame
    anchors: DataFrame
    contexts: DataFrame
    bundles: DataFrame

    @property
    def questions(self) -> DataFrame:
        return self.candidates.questions


def search(
    questions: DataFrame, index: CorpusIndex, config: RetrievalConfig = RetrievalConfig(),
    query_vectors: DataFrame | None = None,
) -> Candidates:
    """Both searches for questions(query_id, question), merged.

    The result is written once: it is small, and fusion, reranking (also by an
    outside model that has to see the candidates first) and experiments start
    from it instead of searching again.
    """
    prepared = prepare_questions(
        questions, config.lexical_query_expansions, config.lexical_query_expansion_enabled,
        config.compat)
    lexical = bm25_search(index.lexical, prepared, config.top_k_lexical, config.compat)
    if query_vectors is None:
        if not index.hashed:
            raise ValueError("an index over given vectors needs query vectors")
        query_vectors = embed_questions(prepared, index.dims)
    dense = dense_search(index.vectors, query_vectors, config.top_k_dense, index.dims, index.hashed)
    return Candidates(prepared, stage(merge_candidates(lexical, dense), "candidates"))


def fused(merged: DataFrame, config: RetrievalConfig) -> DataFrame:
    scaled = normalize_scores(normalize_scores(merged, "lexical"), "dense")
    return fuse_scores(scaled, config.hybrid_alpha, config.hybrid_beta,
                       config.overlap_boost_enabled, config.overlap_boost_value)


def assemble(
    candidates: Candidates, index: CorpusIndex, config: RetrievalConfig = RetrievalConfig(),
    pair_scores: DataFrame | None = None,
) -> Retrieval:
    """Fusion, reranking, context and evidence bundles of searched questions.

    ``pair_scores``(query_id, passage_id, score) drives the reranker; without
    it, or with the reranker disabled, candidates keep their hybrid order.
    Reranked candidates and bundles are written once: both are small, and contexts, answers and
    metrics start from them instead of scoring the pairs again.
    """
    merged = fused(candidates.merged, config)
    reranked = stage(rerank(merged, config.reranker_top_k,
                            pair_scores if config.reranker_enabled else None, config.compat), "reranked")
    anchors = take_anchors(reranked, config.top_k_anchors, config.min_anchor_score)
    contexts = expand_context(anchors, index.passages, config.context_window_radius)
    bundles = stage(
        evidence_bundles(anchors, contexts, config.top_k_anchors, config.max_bundle_passages),
        "bundles")
    return Retrieval(candidates, merged, reranked, anchors, contexts, bundles)


def retrieve(
    questions: DataFrame, index: CorpusIndex, config: RetrievalConfig = RetrievalConfig(),
    query_vectors: DataFrame | None = None, pair_scores: DataFrame | None = None,
) -> Retrieval:
    """All nine stages: ``search``, then ``assemble``."""
    return assemble(search(questions, index, config, query_vectors), index, config, pair_scores)


def candidate_rows(candidates: DataFrame, rank: str, top_k: int | None = None) -> DataFrame:
    """Candidates of every query in order, as one array of debug rows per query."""
    wanted = [
        "passage_id", "lexical_score", "dense_score", "lexical_score_normalized",
        "dense_score_normalized", "overlap_matched", "overlap_boost", "hybrid_score",
        "rerank_score", "rank_lexical", "rank_dense", "rank_hybrid", "rank_rerank",
    ]
    rows = candidates if top_k is None else candidates.where(F.col(rank) < top_k)
    item = F.struct(F.col(rank).alias("place"), *[c for c in wanted if c in candidates.columns])
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))


def _setting_struct(config: RetrievalConfig) -> Column:
    names = ("hybrid_alpha", "hybrid_beta", "overlap_boost_enabled", "overlap_boost_value",
             "reranker_enabled", "reranker_top_k")
    return F.struct(*[F.lit(getattr(config, n)).alias(n) for n in names])


def debug_record(run: Retrieval, config: RetrievalConfig, top_k: int | None = None) -> DataFrame:
    """Per query the question forms, the settings and the candidate lists of each stage."""
    out = run.questions.select(
        "query_id", F.col("question").alias("original_query"),
        F.col("normalized_question").alias("normalized_query"), "lexical_query", "expanded_terms",
        _setting_struct(config).alias("retrieval_config"))
    stages = (
        ("lexical_hits", run.candidates.lexical, "rank_lexical"), ("dense_hits", run.candidates.dense, "rank_dense"),
        ("merged_candidates", run.merged, "rank_hybrid"),
        ("reranked_candidates", run.reranked, "rank_rerank"),
    )
    for name, rows, rank in stages:
        lists = candidate_rows(rows, rank, top_k).withColumnRenamed("rows", name)
        out = out.join(lists, "query_id", "left")
    return out
