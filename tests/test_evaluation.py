import random

import pytest
from pyspark.sql import functions as F

from groundsieve.functions import ranked as R
from groundsieve.operators import evaluation as E

ITEMS = "query_id string, retrieved_ids array<string>, expected_ids array<string>, alternative_ids array<string>"


def plain_metrics(got, relevant, k):
    top = got[:k]
    found = set(top) & set(relevant)
    first = next((1 / n for n, i in enumerate(got, 1) if i in relevant), 0.0)
    return (float(bool(found)), len(found) / len(set(relevant)) if relevant else 1.0,
            sum(i in relevant for i in top) / k, first)


@pytest.mark.parametrize("compat", [False, True])
def test_metrics_match_plain_python(spark, compat):
    rng = random.Random(11)
    pool = [f"p{n}" for n in range(30)]
    rows = [(f"q{n}", rng.sample(pool, rng.randint(0, 25)), rng.sample(pool, rng.randint(0, 4)),
             rng.sample(pool, rng.randint(0, 3))) for n in range(40)]
    got = {r["query_id"]: r for r in E.retrieval_metrics(
        spark.createDataFrame(rows, ITEMS), compat=compat).collect()}
    for q, ids, expected, alternative in rows:
        relevant = set(expected) | set(alternative)
        for k in (5, 10, 20):
            values = [got[q][f"{m}_at_{k}"] for m in ("hit", "recall", "precision")] + [got[q]["mrr"]]
            if not relevant and not compat:
                assert values == [None] * 4
            else:
                assert values == pytest.approx(plain_metrics(ids, relevant, k))


def test_precision_at_zero(spark):
    assert spark.range(1).select(R.precision_at(F.array(F.lit("a")), F.array(F.lit("a")), 0)).first()[0] == 0.0


@pytest.mark.parametrize("lists, kind", [
    (([], ["a"], ["a"], ["a"], ["a"]), "unknown"),
    ((["x"], ["a"], ["a"], ["a"], ["x"]), "none"),
    ((["x"], ["a"], ["x"], ["x"], ["a"]), "lexical_miss"),
    ((["x"], ["x"], ["a"], ["x"], ["a"]), "dense_miss"),
    ((["x"], ["x"], ["x"], ["x"], ["a"]), "rerank_miss"),
    ((["x"], ["x"], ["x"], ["a"], ["a"]), "unknown"),
    ((["x"], [f"p{n}" for n in range(10)] + ["x"], ["x"], ["x"], ["a"]), "lexical_miss"),
])
def test_failure_types(spark, lists, kind):
    columns = [F.array(*[F.lit(i) for i in ids]).cast("array<string>") for ids in lists]
    assert spark.range(1).select(R.failure_type(*columns)).first()[0] == kind


def test_failures_and_histogram(spark):
    items = spark.createDataFrame([("q1", ["a"]), ("q2", ["a"]), ("q3", []), ("q4", ["z"])],
                                  "query_id string, expected_ids array<string>")
    ids = spark.createDataFrame(
        [("q1", ["a"], ["a"], ["a"], ["a"]), ("q2", ["b"], ["a"], ["b"], ["b"]),
         ("q3", ["b"], ["b"], ["b"], ["b"])],
        "query_id string, " + ", ".join(f"{s}_ids array<string>" for s in
                                        ("lexical", "dense", "merged", "reranked")))
    rows = E.classify_failures(items, ids)
    got = {r["query_id"]: r for r in rows.collect()}
    assert [got[q]["failure"] for q in ("q1", "q2", "q3", "q4")] == [False, True, False, True]
    assert got["q1"]["failure_type"] is None and got["q3"]["failure_type"] is None
    assert got["q2"]["failure_type"] == "lexical_miss" and got["q2"]["fusion_miss"]
    assert got["q4"]["miss_both"] and not got["q4"]["fusion_miss"]
    assert {tuple(r) for r in E.failure_histogram(rows).collect()} == {("lexical_miss", 2)}


def test_references_take_the_first_passage(spark):
    passages = spark.createDataFrame(
        [("b", "2|1|later"), ("a", "2|1|first"), ("c", "2|2|x"), ("d", "no ref"), ("e", "x|1|y")],
        "passage_id string, text string")
    wanted = spark.createDataFrame([("q", ["2|2", "9|9", "2|1"]), ("r", []), ("s", ["x|1"])],
                                   "query_id string, refs array<string>")
    got = {r["query_id"]: r["expected_ids"] for r in E.resolve_references(passages, wanted).collect()}
    assert got == {"q": ["c", "a"], "r": [], "s": []}


@pytest.mark.parametrize("small", [True, False])
def test_quotes_are_located_like_by_comparison(spark, monkeypatch, small):
    monkeypatch.setattr(E, "bounded", lambda *_: small)
    rng = random.Random(5)
    words = ["al", "be", "cat", "dog", "be.", "elk"]
    texts = {f"p{n}": " ".join(rng.choices(words, k=rng.randint(1, 12))) for n in range(60)}
    quotes = {f"q{n}": " ".join(rng.choices(words, k=n % 6 + 1))[rng.randint(0, 1):] for n in range(30)}
    passages = spark.createDataFrame(list(texts.items()), "passage_id string, normalized_text string")
    asked = spark.createDataFrame(list(quotes.items()), "query_id string, quote string")
    got = [tuple(r) for r in E.locate_quotes(passages, asked).collect()]
    assert sorted(got) == sorted((q, p) for q, c in quotes.items() for p, t in texts.items() if c in t)


def test_summary_skips_errors_and_unjudged_items(spark):
    rows = spark.createDataFrame(
        [("a", ["x"], ["x"], None), ("b", ["y"], ["x"], None), ("c", ["x"], [], None),
         ("d", [], ["x"], "boom")],
        "query_id string, retrieved_ids array<string>, expected_ids array<string>, error string")
    row = E.summarize_run(E.retrieval_metrics(rows)).first()
    assert (row["total"], row["successful"], row["failed"], row["n_with_gold"]) == (4, 3, 1, 2)
    assert (row["hit_at_5"], row["recall_at_10"], row["precision_at_10"], row["mrr"]) == (
        0.5, 0.5, 0.05, 0.5)


def test_grounding(spark):
    drafts = spark.createDataFrame(
        [("q", ["p1", "zz"], [("p1", "x")]), ("r", [], [])],
        "query_id string, raw_citations array<string>, "
        "supporting_citations array<struct<passage_id:string,quote:string>>")
    reports = spark.createDataFrame(
        [("q", "fail", ["c1"], [("c2", "r"), ("c3", "r")]), ("r", "pass", [], [])],
        "query_id string, status string, supported_claims array<string>, "
        "unsupported_claims array<struct<claim_id:string,reason:string>>")
    bundles = spark.createDataFrame([("q", [("p1",)]), ("r", [("p1",)])],
                                    "query_id string, anchors array<struct<passage_id:string>>")
    got = {r["query_id"]: tuple(r)[1:] for r in E.grounding_metrics(drafts, reports, bundles).collect()}
    assert got == {"q": (0.5, 1 / 3, 2, "fail"), "r": (1.0, 1.0, 0, "pass")}
    old = E.grounding_metrics(drafts, reports, bundles, compat=True)
    assert old.where("query_id = 'q'").first()["citation_validity_rate"] == 1.0


STEP = "struct<attempts:int,structured_success:boolean,repair_attempted:boolean,repair_succeeded:boolean,fallback_used:boolean>"


def test_model_run_summary(spark):
    rows = spark.createDataFrame(
        [("q1", True, True, False, None, (3, True, True, True, False), (1, True, False, False, False)),
         ("q2", False, True, False, None, (3, False, True, False, True), (0, False, False, False, True)),
         ("q3", False, False, True, "boom", None, None)],
        f"query_id string, hit_at_5 boolean, hit_at_10 boolean, failure boolean, error string, "
        f"answer {STEP}, verifier {STEP}")
    row = E.summarize_model_run(rows).first().asDict()
    assert row == {
        "total_queries": 3, "error_count": 1, "hit_at_5": 0.3333, "hit_at_10": 0.6667,
        "failure_count": 1, "fallback_count": 1, "fallback_rate": 0.3333,
        "verifier_fallback_count": 1, "verifier_fallback_rate": 0.3333, "schema_success_rate": 0.3333,
        "answer_schema_success_rate": 0.3333, "verifier_schema_success_rate": 0.3333,
        "average_retries_used": 1.0, "answer_average_retries_used": 2.0,
        "verifier_average_retries_used": 0.0, "repair_used_count": 2, "repair_success_count": 1}
    bare = E.summarize_model_run(rows, generation=False).first()
    assert bare["total_queries"] == 3 and bare["fallback_rate"] is None
