"""Contexts from passages that are stored by neighbourhood."""

import pytest
from pyspark.sql import functions as F

from groundsieve.operators.evidence import context_from_places, expand_context
from groundsieve.sources.places import store_places


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(d, f"{d}-{i}", i, f"text {d} {i}", f"title {i // 7}", i // 7)
            for d, n in (("a", 40), ("b#1", 9), ("b", 15), ("c", 1)) for i in range(n) if i % 6 != 4]
    return spark.createDataFrame(rows, "document_id string, passage_id string, passage_index int, text string, "
                                       "section_title string, section_order int")


@pytest.fixture(scope="module")
def store(passages):
    return store_places(passages, buckets=8, size=4)


@pytest.fixture(scope="module")
def anchors(spark):
    rows = [("q1", "a-3", "own", "t"), ("q1", "a-0", "own", "t"), ("q2", "a-3", "own", "t"), ("q2", "a-39", "own", "t"),
            ("q2", "b-7", "own", "t"), ("q3", "b#1-7", "own", "t"), ("q3", "c-0", None, None), ("q3", "lost", "kept", "mine"),
            ("q4", "gone", None, None), ("q4", "a-12", None, None)]
    return spark.createDataFrame(rows, "query_id string, passage_id string, passage_text string, section_title string")


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_same_contexts(anchors, passages, store, radius):
    for rows in (anchors, anchors.drop("passage_text", "section_title")):
        want = expand_context(rows, passages, radius)
        got = context_from_places(rows, store, radius)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_anchors(anchors, store):
    assert context_from_places(anchors.limit(0), store).count() == 0


def test_stored_passages_do_not_move(spark, anchors, store):
    """Between each scan of a bucketed table and its join there is no exchange, and no broadcast."""
    asked = anchors.select(F.concat("passage_id", F.lit("#0")).alias("neighbourhood"))
    for table, other, key in ((store.places, anchors.select("passage_id"), "passage_id"),
                              (store.passages, asked, "neighbourhood")):
        joined = table.hint("merge").join(other, key)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Broadcast" not in plan
        assert plan.count("Exchange") <= 1 and "Exchange" not in plan.split("FileScan")[0].split("SortMergeJoin")[1]
