"""Retrieval metrics over two arrays: the retrieved ids in order, and the relevant ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CUTOFFS = (5, 10, 20)


def hit_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), relevant), F.lit(False)).cast(
        "double")


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 1 if nothing is relevant."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) == 0, 1.0).otherwise(found / F.size(relevant))


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of relevant ids in the first k, always out of k."""
    if k == 0:
        return F.lit(0.0)
    found = F.filter(F.slice(retrieved, 1, k), lambda i: F.array_contains(relevant, i))
    return F.size(found) / F.lit(k)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """One over the place of the first relevant id; 0 if there is none."""
    places = F.transform(relevant, lambda i: F.nullif(F.array_position(retrieved, i), F.lit(0)))
    return F.coalesce(1.0 / F.array_min(F.array_compact(places)), F.lit(0.0))


def ordered_ids(anchors: Column) -> Column:
    """Anchor ids, then window ids, each id once at its first place."""
    windows = F.flatten(F.transform(anchors, lambda a: a["window_passage_ids"]))
    return F.array_distinct(F.concat(F.transform(anchors, lambda a: a["passage_id"]), windows))


def failure_type(
    expected: Column, lexical: Column, dense: Column, merged: Column, reranked: Column,
    k: int = 10,
) -> Column:
    """Why a question missed; the first matching reason counts, in this order."""
    def within(ids: Column) -> Column:
        return hit_at(ids, expected, k) > 0

    return (
        F.when(F.size(expected) == 0, "unknown")
        .when(within(reranked), "none")
        .when(~within(lexical), "lexical_miss")
        .when(~within(dense), "dense_miss")
        .when(within(merged), "rerank_miss")
        .otherwise("unknown")
    )


def missed_by_both(expected: Column, lexical: Column, dense: Column, k: int = 10) -> Column:
    return (F.size(expected) > 0) & (hit_at(lexical, expected, k) == 0) & (
        hit_at(dense, expected, k) == 0)


def lost_in_fusion(
    expected: Column, lexical: Column, dense: Column, merged: Column, k: int = 10
) -> Column:
    found = (hit_at(lexical, expected, k) > 0) | (hit_at(dense, expected, k) > 0)
    return found & (hit_at(merged, expected, k) == 0)
