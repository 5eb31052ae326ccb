import json

import pytest
from pyspark.sql import functions as F

from groundsieve.config import RetrievalConfig
from groundsieve.plans.evaluation import model_run, run_eval, sweep, sweep_results
from groundsieve.plans.ingest import build_index, ingest
from groundsieve.plans.retrieval import assemble, debug_record, retrieve, search
from groundsieve.sources import corpus as C, questions as Q, tables
from groundsieve.sources.staging import bounded, shared_folder, stage

ASKED = {"patience": "What is said about patience?", "mercy": "What does the text say about mercy?",
         "poor": "Should I feed the poor?", "none": "zzz qqq"}
WORDS = {"patience": "patien", "mercy": "mercy", "poor": "poor"}


@pytest.fixture(scope="module")
def corpus(proverbs):
    return ingest(proverbs)


@pytest.fixture(scope="module")
def index(corpus):
    return build_index(corpus.passages)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "query_id string, question string")


@pytest.fixture(scope="module")
def run(asked, index):
    return retrieve(asked, index)


def test_ingest(corpus):
    rows = corpus.passages.orderBy("passage_index").collect()
    assert [r["passage_index"] for r in rows] == list(range(20))
    assert corpus.windows.count() == 20 and corpus.sections.count() == 1


def test_every_question_finds_its_words(run):
    top = {r["query_id"]: r for r in run.bundles.collect()}
    for query, word in WORDS.items():
        texts = [a["text"].lower() for a in top[query]["anchors"]]
        assert len(texts) <= 6 and any(word in t for t in texts[:2])
    assert all(len({i for a in b["anchors"] for i in a["window_passage_ids"]}) <= 12 for b in top.values())


def test_scores_and_ranks_are_in_range(run):
    for r in run.reranked.collect():
        assert 0 <= r["hybrid_score"] <= 1 and 0 <= r["rank_rerank"] < 25
        for c in ("lexical_score_normalized", "dense_score_normalized"):
            assert r[c] is None or 0 <= r[c] <= 1
    ranks = run.merged.groupBy("query_id").agg(F.sort_array(F.collect_list("rank_hybrid")).alias("r"))
    assert all(r["r"] == list(range(len(r["r"]))) for r in ranks.collect())


def test_debug_record(run):
    rows = {r["query_id"]: r for r in debug_record(run, RetrievalConfig(), top_k=3).collect()}
    assert set(rows) == set(ASKED)
    row = rows["mercy"]
    assert row["lexical_query"].split()[0] == "mercy" and "compassion" in row["expanded_terms"]
    assert [len(row[c]) <= 3 for c in ("lexical_hits", "dense_hits", "merged_candidates")] == [True] * 3
    assert [r["place"] for r in row["reranked_candidates"]] == [0, 1, 2]
    assert row["retrieval_config"]["hybrid_alpha"] == 0.5
    assert rows["none"]["lexical_hits"] is None


def test_outside_reranker_and_its_switch(spark, asked, index):
    found = search(asked, index)
    pairs = found.merged.select("query_id", "passage_id", (-F.col("dense_score")).alias("score"))
    order = {}
    for name, config in (("on", RetrievalConfig()), ("off", RetrievalConfig(reranker_enabled=False))):
        rows = assemble(found, index, config, pairs).reranked
        order[name] = [tuple(r) for r in rows.orderBy("query_id", "rank_rerank").select(
            "query_id", "passage_id").collect()]
    assert order["on"] != order["off"] and sorted(order["on"]) == sorted(order["off"])


def test_compat_run(asked, index, corpus):
    config = RetrievalConfig(compat=True)
    plain = retrieve(asked, build_index(corpus.passages, config), config)
    counts = plain.candidates.lexical.groupBy("query_id").count().collect()
    assert {r["count"] for r in counts} == {20} and len(counts) == len(ASKED)


def test_results_do_not_depend_on_partitioning(asked, index, run):
    again = retrieve(asked.repartition(1), build_index(index.passages.repartition(7)))
    assert sorted(map(str, again.bundles.collect())) == sorted(map(str, run.bundles.collect()))


def test_eval_run(spark, asked, index):
    passages = index.passages
    gold = asked.join(spark.createDataFrame(
        [(q, w) for q, w in WORDS.items()], "query_id string, word string"), "query_id").join(
        passages, F.contains(F.lower("text"), F.col("word"))).groupBy("query_id").agg(
        F.collect_set("passage_id").alias("expected_ids"))
    items = asked.join(gold, "query_id", "left").withColumn(
        "expected_ids", F.coalesce("expected_ids", F.array().cast("array<string>")))
    out = run_eval(items, index)
    row = out.summary.first()
    assert (row["total"], row["n_with_gold"], row["hit_at_5"]) == (4, 3, 1.0)
    assert row["claim_support_rate"] == 1.0 and row["avg_unsupported_claims"] == 0.0
    bare = run_eval(items, index, generation=False)
    assert "claim_support_rate" not in bare.summary.columns

    found = retrieve(asked, index)
    results, summary, _ = model_run(items, found, "base")
    assert summary.first()["fallback_rate"] == 1.0 and results.count() == 4
    fused, reranked = sweep(found.candidates.merged, {
        "a": RetrievalConfig(), "b": RetrievalConfig(hybrid_alpha=1.0, hybrid_beta=0.0)})
    rows = sweep_results(items, fused, reranked)
    assert rows.groupBy("label").count().collect()[0]["count"] == 4
    alone = found.merged.select("query_id", "passage_id", "hybrid_score", "rank_hybrid")
    swept = fused.where("label = 'a'").select(alone.columns)
    assert sorted(alone.collect()) == sorted(swept.collect())


def test_index_survives_saving(spark, asked, index, run, tmp_path):
    tables.save_index(index, str(tmp_path), "one")
    tables.save_index(index, str(tmp_path), "two")
    tables.save_index(index, str(tmp_path), "one")
    loaded = tables.load_index(spark, str(tmp_path), "one")
    assert loaded.passages.count() == 20
    again = retrieve(asked, loaded)
    assert sorted(map(str, again.bundles.collect())) == sorted(map(str, run.bundles.collect()))
    plan = loaded.passages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


def test_run_artifacts(spark, run, tmp_path):
    tables.save_candidates(run.reranked, str(tmp_path / "c"))
    rows = tables.read_candidates(spark, str(tmp_path / "c"), "mercy").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert all(r["raw_score"] == (r["rerank_score"] or r["hybrid_score"]) for r in rows)
    for _ in range(2):
        tables.save_artifact(run.bundles, str(tmp_path), "bundles")
    stored = tables.read_artifact(spark, str(tmp_path), "bundles")
    assert stored.count() == 8 and "created_at" in stored.columns
    tables.save_results(run.questions.select("query_id", "lexical_query"), str(tmp_path / "r"), "x")
    assert tables.read_results(spark, str(tmp_path / "r"), "x").count() == 4


def test_question_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([
        {"id": "q2", "question": "b?", "expected_verse_refs": ["1|2"]},
        {"id": "q1", "question": "a?", "category": "c", "expected_relevant_passage_ids": ["p"]}], indent=1))
    first = Q.read_questions(spark, str(tmp_path / "q.json"), first=1).collect()
    assert [(r["query_id"], r["category"], r["refs"]) for r in first] == [("q1", "c", [])]
    items = {r["query_id"]: r for r in Q.read_eval_items(spark, str(tmp_path / "q.json")).collect()}
    assert items["q1"]["expected_ids"] == ["p"] and items["q2"]["expected_ids"] == []
    assert (items["q2"]["mode"], items["q2"]["minimum_expected_count"], items["q2"]["ambiguity_flag"]) == (
        "source_only", 1, False)


def test_texts_and_units(spark, tmp_path):
    (tmp_path / "book.txt").write_text("1|1|In  the beginning\n1|2|there was\nnoise\nx|1|bad\n3|1|an|end\n")
    texts = C.read_texts(spark, str(tmp_path / "book.txt"))
    units = C.parse_units(texts).collect()
    assert [(r["chapter"], r["unit"], r["text"]) for r in units] == [
        (1, "1", "In  the beginning"), (1, "2", "there was"), (3, "1", "an|end")]
    docs = C.as_documents(texts, "document_id", sectioning="explicit", passages="natural_units")
    out = ingest(C.with_chapter_boundaries(docs, {1: "Opening"}))
    assert [(r["title"], r["order_index"]) for r in out.sections.orderBy("order_index").collect()] == [
        ("Opening", 0), ("Chapter 3", 1)]
    assert [r["text"] for r in out.passages.orderBy("passage_index").collect()] == [
        "1|1|In the beginning", "1|2|there was", "3|1|an|end"]
    # From the raw text every offset behind the double blank is one too far.
    raw = C.with_chapter_boundaries(docs, compat=True).first()["section_boundaries"]
    exact = C.with_chapter_boundaries(docs).first()["section_boundaries"]
    assert raw[1]["start_offset"] == exact[1]["start_offset"] + 1
    with pytest.raises(Exception):
        C.read_texts(spark, str(tmp_path / "absent.txt")).count()


def test_projects_and_listing(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3)],
                                 "document_id string, project_id string, created_at int")
    got = C.newest_first(C.only_project(rows, "x")).collect()
    assert [r["document_id"] for r in got] == ["b", "a"]


def test_staging(spark, tmp_path):
    assert bounded(spark.range(5), 5) and not bounded(spark.range(6), 5)
    assert shared_folder(spark) == shared_folder(spark)
    rows = stage(spark.range(10), "ten")
    assert rows.count() == 10 and shared_folder(spark) in rows.inputFiles()[0]


