"""Broken vectors, settings and outputs do no harm to their neighbours, and no question vanishes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from groundsieve.config import RetrievalConfig
from groundsieve.functions.outputs import ANSWER
from groundsieve.operators.answers import NO_EVIDENCE, answer_drafts, final_responses, verification_reports
from groundsieve.operators.dense import broken_vectors, dense_search
from groundsieve.operators.evaluation import grounding_metrics
from groundsieve.operators.outputs import check_outputs, is_whole_json
from groundsieve.plans.evaluation import sweep, sweep_results
from test_answers import ANCHOR, anchor

VECTOR = "id string, vector array<float>"
CANDIDATE = ("query_id string, passage_id string, lexical_score double, rank_lexical int, dense_score double, "
             "rank_dense int")


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, VECTOR).withColumnRenamed("id", key)


def test_broken_vectors_hide_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [inf, 0.0]), ("f", [0.0, 0.0])]
    held = vectors(spark, rows, "passage_id").coalesce(1)
    asked = vectors(spark, [("q", [1.0, 1.0]), ("r", [nan, 0.0]), ("s", None)], "query_id")
    got = dense_search(held, asked, 6, dims=2, hashed=False).collect()
    assert [(r["query_id"], r["passage_id"], r["rank_dense"]) for r in sorted(got, key=lambda r: r["rank_dense"])] == [
        ("q", "a", 0), ("q", "c", 1), ("q", "f", 2)]
    assert {tuple(r) for r in broken_vectors(held).collect()} == {
        ("b", "not finite"), ("d", "missing"), ("e", "not finite")}


def test_a_vector_of_another_length_is_an_error_that_names_it(spark):
    held = vectors(spark, [("a", [1.0, 0.0]), ("wrong", [1.0, 0.0, 0.0]), ("short", [1.0])], "passage_id")
    with pytest.raises(Exception, match="vector of (wrong|short) has . numbers, not 2"):
        dense_search(held, vectors(spark, [("q", [1.0, 1.0])], "query_id"), 2, dims=2, hashed=False).collect()


def test_the_cut_of_a_query_is_salted(spark):
    held = vectors(spark, [(str(k), [1.0, k / 10]) for k in range(50)], "passage_id")
    out = dense_search(held, vectors(spark, [("q", [1.0, 0.0])], "query_id"), 5, dims=2, hashed=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 2 and "salt" in plan
    assert [r["passage_id"] for r in out.orderBy("rank_dense").collect()] == ["0", "1", "2", "3", "4"]


def candidates(spark):
    return spark.createDataFrame(
        [("q1", f"p{k}", 5.0 - k, k, 0.5, k) for k in range(3)], CANDIDATE).withColumn("overlap_matched", F.lit(True))


def test_a_quirky_setting_leaves_the_others_alone(spark):
    pairs = spark.createDataFrame([("q1", "p0", math.nan), ("q1", "p1", 1.0), ("q1", "p2", 5.0)],
                                  "query_id string, passage_id string, score double")
    _, alone = sweep(candidates(spark), {"x": RetrievalConfig()}, pairs)
    _, both = sweep(candidates(spark), {"x": RetrievalConfig(), "y": RetrievalConfig(compat=True)}, pairs)
    pick = lambda df: sorted((r["passage_id"], r["rank_rerank"], r["rerank_score"]) for r in df.collect())
    assert pick(both.where("label = 'x'")) == pick(alone)
    assert [r["passage_id"] for r in both.where("label = 'y'").orderBy("rank_rerank").collect()] == ["p0", "p1", "p2"]


@pytest.mark.parametrize("labels", [(), ("x",)])
def test_items_without_candidates_stay_in_the_sweep(spark, labels):
    items = spark.createDataFrame([("q1", ["p0"]), ("q2", ["p9"])], "query_id string, expected_ids array<string>")
    rows = {r["query_id"]: r for r in sweep_results(items, *sweep(
        candidates(spark), {"x": RetrievalConfig()}), labels).collect()}
    assert rows["q1"]["hit_at_10"] and rows["q2"]["failure"] and rows["q2"]["label"] == "x"


def test_questions_without_evidence_get_their_error(spark):
    bundles = spark.createDataFrame(
        [("q1", [anchor("p1", "Patience wins.", 1)]), ("q2", [])], f"query_id string, anchors array<{ANCHOR}>")
    drafts = answer_drafts(bundles)
    reports = verification_reports(drafts, bundles)
    got = {r["query_id"]: r for r in final_responses(drafts, reports, bundles).collect()}
    assert got["q2"]["error"] == NO_EVIDENCE and got["q2"]["verification_status"] == "fail"
    assert got["q2"]["citations"] == [] and got["q1"]["error"] is None
    assert {r["query_id"] for r in grounding_metrics(drafts, reports, bundles).collect()} == {"q1", "q2"}


def test_text_behind_json_is_repaired(spark, values):
    good = json.dumps({"final_answer": "x", "claims": [], "supporting_citations": [], "objections_raised": [],
                       "confidence_notes": ""})
    texts = [good, good + " Done.", "Here: " + good, "[1], [2]", '"a": 1', "[1]", "{", None, good + "}"]
    assert values(is_whole_json, texts) == [True, False, False, False, False, True, False, False, False]
    rows = spark.createDataFrame([("q", n, t) for n, t in enumerate(texts[:3])], "query_id string, attempt int, raw_output string")
    got = check_outputs(rows, ANSWER).orderBy("attempt").collect()
    assert [(r["repair_attempted"], r["repair_succeeded"], r["failure_stage"]) for r in got] == [
        (False, False, None), (True, True, None), (True, True, None)]
