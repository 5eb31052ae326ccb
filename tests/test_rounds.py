"""Artifacts of several rounds, many quotes, and documents that are split once."""

import random

from pyspark.sql import functions as F

from groundsieve.operators.evaluation import locate_many_quotes
from groundsieve.operators.outputs import latest, matched_rounds
from groundsieve.plans.ingest import ingest, ingest_once

ROW = "query_id string, created_at int, artifact_id string, v string"


def triples(spark, bundles, drafts, reports):
    tables = [spark.createDataFrame([("q", *r) for r in rows], ROW) for rows in (bundles, drafts, reports)]
    rows = matched_rounds(*tables).orderBy("round").collect()
    return [(r["round"], r["draft"]["v"], r["bundle"] and r["bundle"]["v"], r["report"] and r["report"]["v"]) for r in rows]


def test_rounds_that_came_in_mixed(spark):
    assert triples(spark, [(1, "a", "b1"), (5, "b", "b2"), (20, "c", "b3")], [(2, "a", "d1"), (6, "b", "d2"), (9, "c", "d3")],
                   [(3, "a", "r1"), (7, "b", "r2"), (8, "c", "r2 again")]) == [
        (1, "d1", "b1", "r1"), (2, "d2", "b2", "r2 again"), (3, "d3", "b2", None)]


def test_artifacts_of_one_time(spark):
    # Bundle, draft and report in this order; of one kind by their ids.
    assert triples(spark, [(1, "a", "b1"), (1, "b", "b2")], [(1, "a", "d1"), (1, "b", "d2")], [(1, "b", "r2"), (1, "a", "r1")]) == [
        (1, "d1", "b2", None), (2, "d2", "b2", "r2")]
    rows = spark.createDataFrame([("q", 1, "a", "x"), ("q", 1, "b", "y")], ROW)
    assert [r["v"] for r in latest(rows, "created_at", ties=("artifact_id",)).collect()] == ["y"]


def test_missing_artifacts(spark):
    assert triples(spark, [(3, "a", "b1")], [(2, "a", "d1")], [(1, "a", "r0")]) == [(1, "d1", None, None)]
    assert triples(spark, [(3, "a", "b1")], [], [(1, "a", "r0")]) == []


def test_many_quotes(spark):
    rng = random.Random(4)
    texts = [(f"p{i}", "".join(rng.choices("ab c", k=rng.randint(0, 40)))) for i in range(120)] + [("null", None), ("é", "l'été 東京")]
    quotes = [(f"q{i % 30}", "".join(rng.choices("ab c", k=rng.randint(0, 5)))) for i in range(150)] + [("x", "été 東"), ("x", "été 東"), ("y", "ab")]
    passages = spark.createDataFrame(texts, "passage_id string, normalized_text string").repartition(3)
    asked = spark.createDataFrame(quotes, "query_id string, quote string")
    want = sorted({(q, p) for q, quote in quotes for p, text in texts if quote and text and quote in text})
    for sizes in ((100_000, 16_000_000), (7, 16_000_000), (1000, 50)):
        assert sorted(map(tuple, locate_many_quotes(passages, asked, *sizes).collect())) == want
    assert locate_many_quotes(passages, asked.limit(0)).count() == 0


def test_documents_are_split_once(spark, proverbs):
    docs = proverbs.unionByName(proverbs.withColumns({"document_id": F.lit("two"), "text": F.lit("# A\none\n\n# B\ntwo\nthree"),
                                                      "sectioning_strategy": F.lit("heading")}))
    once, thrice = ingest_once(docs), ingest(docs)
    for name in ("sections", "passages", "windows"):
        got, want = getattr(once, name), getattr(thrice, name)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for name, other in (("passages", "sections#"), ("windows", "sections#"), ("sections", "passages#")):
        plan = getattr(once, name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and other not in plan
