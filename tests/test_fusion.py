import math
import random

import pytest

from groundsieve.operators.evidence import (
    bundle_anchors, context_from_windows, evidence_bundles, expand_context, take_anchors,
)
from groundsieve.operators.fusion import (
    count_broken_scores, fuse_scores, merge_candidates, normalize_scores, rerank, score_pairs,
)

LEX = "query_id string, passage_id string, lexical_score double, rank_lexical int"
DEN = "query_id string, passage_id string, dense_score double, rank_dense int"


def merged(spark, lexical, dense):
    left = spark.createDataFrame([("q", p, float(s), r) for r, (p, s) in enumerate(lexical)], LEX)
    right = spark.createDataFrame([("q", p, float(s), r) for r, (p, s) in enumerate(dense)], DEN)
    return merge_candidates(left, right)


def fused(spark, lexical, dense, **settings):
    rows = merged(spark, lexical, dense)
    return fuse_scores(normalize_scores(normalize_scores(rows, "lexical"), "dense"), **settings)


def by_id(df):
    return {r["passage_id"]: r for r in df.collect()}


def test_union_keeps_both_scores(spark):
    got = by_id(merged(spark, [("a", 3), ("b", 2)], [("b", 0.9), ("c", 0.5)]))
    assert set(got) == {"a", "b", "c"}
    assert (got["b"]["lexical_score"], got["b"]["dense_score"]) == (2.0, 0.9)
    assert (got["b"]["rank_lexical"], got["b"]["rank_dense"]) == (1, 0)
    assert got["b"]["overlap_matched"] and not got["a"]["overlap_matched"]
    assert [got[p]["source_methods"] for p in "abc"] == [
        ["lexical"], ["lexical", "dense"], ["dense"]]


def test_min_max(spark):
    got = by_id(normalize_scores(merged(spark, [("a", 10), ("b", 5), ("c", 0)], [("d", 1)]), "lexical"))
    assert [got[p]["lexical_score_normalized"] for p in "abcd"] == [1.0, 0.5, 0.0, None]
    flat = by_id(normalize_scores(merged(spark, [("a", 5), ("b", 5)], []), "lexical"))
    assert [flat[p]["lexical_score_normalized"] for p in "ab"] == [0.0, 0.0]


def test_weights_and_order(spark):
    args = ([("a", 10), ("b", 0)], [("b", 1.0), ("c", 0.2)])
    got = by_id(fused(spark, *args, alpha=0.7, beta=0.3))
    assert [got[p]["hybrid_score"] for p in "abc"] == [0.7, 0.3, 0.0]
    assert [got[p]["rank_hybrid"] for p in "abc"] == [0, 1, 2]
    # Equal scores: lexical hits in their order come before dense ones.
    tied = by_id(fused(spark, [("z", 5), ("y", 5)], [("a", 1), ("b", 1)]))
    assert [tied[p]["rank_hybrid"] for p in "zyab"] == [0, 1, 2, 3]


def test_boost_only_on_overlap(spark):
    args = ([("a", 10), ("b", 5)], [("b", 1.0), ("c", 0.2)])
    got = by_id(fused(spark, *args, boost_enabled=True, boost_value=0.1))
    assert [got[p]["overlap_boost"] for p in "abc"] == [0.0, 0.1, 0.0]
    plain = by_id(fused(spark, *args))
    assert round(got["b"]["hybrid_score"] - plain["b"]["hybrid_score"], 9) == 0.1


def reranked(spark, scores, top_k=10, **kw):
    rows = fused(spark, [("a", 4), ("b", 3), ("c", 2), ("d", 1)], [])
    pairs = spark.createDataFrame([("q", p, s) for p, s in scores.items()],
                                  "query_id string, passage_id string, score double")
    out = rerank(rows, top_k, pairs, **kw)
    return [r["passage_id"] for r in out.orderBy("rank_rerank").collect()], out


def test_rerank_orders_by_the_outside_score(spark):
    assert reranked(spark, {"a": 0.1, "b": 0.2, "c": 0.9, "d": 0.5})[0] == ["c", "d", "b", "a"]
    assert reranked(spark, {"a": 0.1, "b": 0.2, "c": 0.9, "d": 0.5}, top_k=2)[0] == ["b", "a"]


def test_nan_and_missing_scores_fall_back_to_hybrid(spark):
    # Hybrid scores: a .5, b .333333, c .166667, d 0.
    order, out = reranked(spark, {"a": math.nan, "c": 0.4, "d": 0.9})
    assert order == ["d", "a", "c", "b"]
    assert by_id(out)["a"]["rerank_score"] == 0.5


def test_nan_scores_freeze_the_order_under_compat(spark):
    order, out = reranked(spark, {"a": math.nan, "b": 0.1, "c": 0.4, "d": 0.9}, compat=True)
    assert order == ["a", "b", "c", "d"] and math.isnan(by_id(out)["a"]["rerank_score"])
    assert reranked(spark, {"b": 0.1, "c": -0.4, "d": 0.9}, compat=True)[0] == ["d", "b", "a", "c"]


def test_without_scores_the_order_stays(spark):
    rows = rerank(fused(spark, [("a", 4), ("b", 3)], []), 10)
    got = by_id(rows)
    assert [(got[p]["rank_rerank"], got[p]["rerank_score"]) for p in "ab"] == [(0, 0.5), (1, 0.0)]


def test_broken_scores_are_counted(spark):
    pairs = spark.createDataFrame([("q", "a", math.nan), ("q", "b", None), ("q", "c", 1.0)],
                                  "query_id string, passage_id string, score double")
    assert tuple(count_broken_scores(pairs).first()) == ("q", 3, 2)


def test_user_scorer(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, passage_id string")
    asked = spark.createDataFrame([("q", "xx")], "query_id string, normalized_question string")
    texts = spark.createDataFrame([("a", "1234"), ("b", "1")], "passage_id string, text string")
    got = score_pairs(rows, asked, texts, lambda q, t: (F.length(t) - F.length(q)).cast("double"))
    assert {r["passage_id"]: r["score"] for r in got.collect()} == {"a": 2.0, "b": -1.0}


PASSAGES = ("document_id string, passage_id string, passage_index int, text string, "
            "section_title string, section_order int")


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(
        [(d, f"{d}{i}", i, f"text {d}{i}", f"S{i // 4}", i // 4) for d in "xy" for i in range(9)
         if (d, i) != ("y", 4)], PASSAGES)


def anchors_of(spark, ids_by_query):
    rows = [(q, p, n, 1.0 - n / 10, 2.0, None, 0.123456)
            for q, ids in ids_by_query.items() for n, p in enumerate(ids)]
    return spark.createDataFrame(rows, (
        "query_id string, passage_id string, rank_rerank int, rerank_score double, "
        "lexical_score double, dense_score double, hybrid_score double"))


def test_context_of_neighbours(spark, passages):
    anchors = anchors_of(spark, {"q": ["x0", "x4", "y3", "gone"], "r": ["x4"]})
    got = {(r["query_id"], r["passage_id"]): r for r in expand_context(anchors, passages, 1).collect()}
    assert got["q", "x0"]["window_passage_ids"] == ["x0", "x1"]
    assert got["q", "x4"]["window_passage_ids"] == ["x3", "x4", "x5"] == got["r", "x4"]["window_passage_ids"]
    assert got["q", "x4"]["window_text"] == "text x3 text x4 text x5"
    assert (got["q", "x4"]["section_title"], got["q", "x4"]["section_order_index"]) == ("S1", 1)
    assert got["q", "y3"]["window_passage_ids"] == ["y2", "y3"]
    assert got["q", "gone"]["window_passage_ids"] == ["gone"]
    assert len(got) == 5


def test_missing_anchor_keeps_the_text_it_carries(spark, passages):
    from pyspark.sql import functions as F

    anchors = anchors_of(spark, {"q": ["gone"]}).withColumns(
        {"passage_text": F.lit("own words"), "section_title": F.lit("own title")})
    row = expand_context(anchors, passages, 1).first()
    assert (row["anchor_text"], row["window_text"], row["section_title"]) == (
        "own words", "own words", "own title")


def test_contexts_from_stored_windows(spark, proverbs):
    from groundsieve.plans.ingest import ingest

    corpus = ingest(proverbs)
    anchors = anchors_of(spark, {"q": ["book-0", "book-7", "book-19"]})
    read = {r["passage_id"]: (r["window_passage_ids"], r["window_text"])
            for r in context_from_windows(anchors, corpus.windows).collect()}
    joined = {r["passage_id"]: (r["window_passage_ids"], r["window_text"])
              for r in expand_context(anchors, corpus.passages).collect()}
    assert read == joined and len(read) == 3


def plain_bundle(ids, window_of, top_k, limit):
    seen, out = [], []
    for p in ids[:top_k]:
        if len(seen) >= limit:
            break
        fresh = [w for w in window_of(p) if w not in seen][: limit - len(seen)]
        seen += fresh
        out.append((p, fresh))
    return out


@pytest.mark.parametrize("limit, top_k, radius", [(12, 6, 1), (4, 6, 1), (5, 3, 2), (1, 6, 1), (100, 2, 3)])
def test_bundles_share_the_budget(spark, passages, limit, top_k, radius):
    rng = random.Random(limit)
    pool = [r["passage_id"] for r in passages.collect()]
    asked = {f"q{n}": rng.sample(pool, 8) for n in range(6)}
    anchors = anchors_of(spark, asked)
    contexts = expand_context(anchors, passages, radius)
    got = {}
    for r in bundle_anchors(evidence_bundles(anchors, contexts, top_k, limit)).collect():
        got.setdefault(r["query_id"], []).append(r)

    def window_of(p):
        return [f"{p[0]}{i}" for i in range(9) if abs(i - int(p[1])) <= radius and f"{p[0]}{i}" in pool]

    for q, ids in asked.items():
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [(r["passage_id"], r["window_passage_ids"]) for r in rows] == plain_bundle(
            ids, window_of, top_k, limit)
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        for r in rows:
            assert r["window_text"] == " ".join("text " + w for w in window_of(r["passage_id"]))
            assert r["kept_text"] == " ".join("text " + w for w in r["window_passage_ids"])


def test_bundle_scores_are_rounded_and_never_null(spark, passages):
    anchors = anchors_of(spark, {"q": ["x1"]})
    row = bundle_anchors(evidence_bundles(anchors, expand_context(anchors, passages))).first()
    assert row["scores"] == {"lexical": 2.0, "hybrid": 0.1235, "rerank": 1.0}


def test_minimum_anchor_score(spark):
    anchors = anchors_of(spark, {"q": ["x0", "x1", "x2"]})
    assert take_anchors(anchors, 6, 0.9).count() == 2 and take_anchors(anchors, 1).count() == 1
