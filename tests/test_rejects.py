"""Readers that keep what they cannot use, and a scorer that may fail."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from groundsieve.operators.fusion import rerank, score_pairs_in_batches
from groundsieve.sources import corpus as C, questions as Q
from groundsieve.sources.rejects import accepted, check_eval_items, check_questions, check_texts, check_units, rejected

REJECT = ["source", "place", "reason", "raw"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.txt").write_text("één\ntwo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfeabc")
    checked = check_texts(spark, str(tmp_path))
    assert checked.count() == 2
    assert [tuple(r) for r in accepted(checked).collect()] == [("a/good.txt", "één\ntwo")]
    bad = rejected(checked)
    assert bad.columns == REJECT
    assert [tuple(r) for r in bad.collect()] == [
        ("bad.txt", None, "not UTF-8", base64.b64encode(b"\xff\xfeabc").decode())]


def test_unit_lines(spark):
    docs = spark.createDataFrame([
        ("a", "1|1|In the beginning\n\n1|2\nx|1|bad\n 3 |1|an|end\n9999999999|1|large"), ("b", None), ("c", "")],
        "document_id string, text string")
    checked = check_units(docs)
    assert checked.count() == 6 + 1 + 1
    want = sorted(map(tuple, C.parse_units(docs).collect()))
    assert sorted(map(tuple, accepted(checked).collect())) == want and len(want) == 2
    assert sorted(map(tuple, rejected(checked).collect()), key=str) == sorted([
        ("a", 1, "blank", ""), ("a", 2, "fewer than three fields", "1|2"), ("a", 3, "chapter is no number", "x|1|bad"),
        ("a", 5, "chapter is no number", "9999999999|1|large"), ("b", None, "no text", None), ("c", 0, "blank", "")], key=str)


ITEMS = [
    {"id": "q1", "question": "a?", "expected_relevant_passage_ids": ["p"], "ambiguity_flag": True, "extra": {"x": 1}},
    {"id": "q2", "question": "b?", "mode": None, "notes": "n", "minimum_expected_count": 3},
    {"question": "no id"}, {"id": 7, "question": "c?"}, {"id": "q3", "question": None}, {"id": "q4", "question": "d?", "mode": 5},
    {"id": "q5", "question": "e?", "expected_relevant_passage_ids": "p"}, {"id": "q6", "question": "f?", "minimum_expected_count": "2"},
    {"id": "q7", "question": "g?", "ambiguity_flag": 1}, "text", None, [1]]


def test_eval_items(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps(ITEMS, indent=1))
    (tmp_path / "cut.json").write_text(json.dumps(ITEMS)[:50])
    (tmp_path / "object.json").write_text('{"id": "q"}')
    (tmp_path / "none.json").write_text("[]")
    checked = check_eval_items(spark, str(tmp_path))
    assert checked.count() == len(ITEMS) + 3
    good = {r["query_id"]: r.asDict() for r in accepted(checked).collect()}
    assert set(good) == {"q1", "q2"}
    (tmp_path / "sound").mkdir()
    (tmp_path / "sound" / "two.json").write_text(json.dumps(ITEMS[:2]))
    for r in Q.read_eval_items(spark, str(tmp_path / "sound" / "two.json")).collect():
        assert r.asDict() == good[r["query_id"]]
    reasons = {(r["source"], r["place"]): r["reason"] for r in rejected(checked).collect()}
    assert reasons == {
        ("cut.json", None): "no JSON", ("object.json", None): "no list of items", ("none.json", None): "an empty list",
        ("items.json", 2): "id is missing", ("items.json", 3): "id has the wrong type",
        ("items.json", 4): "question is missing", ("items.json", 5): "mode has the wrong type",
        ("items.json", 6): "expected_relevant_passage_ids has the wrong type",
        ("items.json", 7): "minimum_expected_count has the wrong type", ("items.json", 8): "ambiguity_flag has the wrong type",
        ("items.json", 9): "no object", ("items.json", 10): "no object", ("items.json", 11): "no object"}
    raw = {r["place"]: r["raw"] for r in rejected(checked).where("source = 'items.json'").collect()}
    assert json.loads(raw[2]) == ITEMS[2] and json.loads(raw[9]) == "text"


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([
        {"id": "q1", "question": "a?", "expected_verse_refs": ["1|2"]}, {"id": "q2", "question": "b?", "expected_verse_refs": [1]}]))
    checked = check_questions(spark, str(tmp_path))
    (one,) = accepted(checked).collect()
    assert one.asDict() == Q.read_questions(spark, str(tmp_path / "q.json"), first=1).first().asDict()
    assert [r["reason"] for r in rejected(checked).collect()] == ["expected_verse_refs has the wrong type"]


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(q, f"p{i}", 1.0 - i / 10, i) for q in ("good", "bad", "nan", "poor") for i in range(5)]
    return spark.createDataFrame(rows, "query_id string, passage_id string, hybrid_score double, rank_hybrid int")


def test_a_scorer_that_fails_for_some_queries(spark, candidates):
    def make_scorer():
        def score(questions, texts):
            if "bad" in questions:
                raise RuntimeError("no bad ones")
            return [float("nan") if q == "nan" and t == "xx" else float(len(t)) for q, t in zip(questions, texts)]

        return score

    asked = spark.createDataFrame([(q, q) for q in ("good", "bad", "nan", "poor")], "query_id string, normalized_question string")
    texts = spark.createDataFrame([(f"p{i}", "x" * (i + 1)) for i in range(5)], "passage_id string, text string")
    for batch in (1, 3, 64):
        scores = score_pairs_in_batches(candidates, asked, texts, make_scorer, batch)
        rows = {(r["query_id"], r["passage_id"]): r for r in scores.collect()}
        assert len(rows) == 20 and all(
            r["score"] is None and r["error"] == "RuntimeError: no bad ones" if q == "bad" else r["error"] is None
            for (q, _), r in rows.items())
        out = rerank(candidates, 10, scores, whole_queries=True)
        order = {q: [r["passage_id"] for r in out.where(F.col("query_id") == q).orderBy("rank_rerank").collect()]
                 for q in ("good", "bad", "nan", "poor")}
        hybrid, scored = [f"p{i}" for i in range(5)], [f"p{i}" for i in reversed(range(5))]
        assert order == {"good": scored, "poor": scored, "bad": hybrid, "nan": hybrid}
        kept = out.where("query_id = 'nan'").select((F.col("rerank_score") == F.col("hybrid_score")).alias("same")).collect()
        assert all(r["same"] for r in kept)


def test_a_scorer_of_too_few_numbers(spark, candidates):
    asked = candidates.select("query_id").distinct().withColumn("normalized_question", F.col("query_id"))
    texts = spark.createDataFrame([(f"p{i}", "x") for i in range(5)], "passage_id string, text string")
    scores = score_pairs_in_batches(candidates, asked, texts, lambda: lambda q, t: [1.0] * (len(t) - 1), 4)
    assert {r["error"].split(":")[0] for r in scores.collect()} == {"ValueError"}
