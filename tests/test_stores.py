"""Stores: runs that are written once, projects, indexes that change as a whole."""

import pytest
from pyspark.sql import functions as F

from groundsieve.plans.ingest import build_index, ingest
from groundsieve.sources import corpus as C, tables
from groundsieve.sources.commits import (
    commit, committed, lost_attempts, read_runs, write_attempt, write_run,
)

NAMES = ["1", "01", "1.0", "a/b", "a=b", "50%", "é ü", "null", "2024-01-01", "A", "a"]


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def read(spark, path, **more):
    return sorted((r["run"], r["n"]) for r in read_runs(spark, path, "t", **more).collect())


def test_runs_with_like_names_stay_apart(spark, tmp_path):
    for i, name in enumerate(NAMES):
        write_run({"t": numbers(spark, i, i + 100)}, str(tmp_path), name)
    assert read(spark, str(tmp_path)) == sorted((n, v) for i, n in enumerate(NAMES) for v in (i, i + 100))
    for i, name in enumerate(NAMES):
        assert read(spark, str(tmp_path), run=name) == [(name, i), (name, i + 100)]
    some = spark.createDataFrame([("01",), ("a/b",), ("absent",), ("01",)], "wanted string")
    assert read(spark, str(tmp_path), runs=some) == [("01", 1), ("01", 101), ("a/b", 3), ("a/b", 103)]


def test_a_run_that_is_tried_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path)
    write_run({"t": numbers(spark, 1), "u": numbers(spark, 7)}, path, "x")
    write_run({"t": numbers(spark, 5)}, path, "y")
    write_run({"t": numbers(spark, 2, 3), "u": numbers(spark, 8)}, path, "x")
    assert read(spark, path) == [("x", 2), ("x", 3), ("y", 5)]
    assert [r["n"] for r in read_runs(spark, path, "u").collect()] == [8]
    assert [(r["run"]) for r in lost_attempts(spark, path, "t").collect()] == ["x"]


def test_a_killed_run_leaves_nothing_that_is_read(spark, tmp_path):
    path = str(tmp_path)
    write_run({"t": numbers(spark, 1)}, path, "x")
    attempt = write_attempt({"t": numbers(spark, 9)}, path, "x")  # killed before its commit
    write_attempt({"t": numbers(spark, 9)}, path, "z")
    with pytest.raises(Exception):  # killed while it writes the second table
        write_run({"t": numbers(spark, 9), "u": numbers(spark, 1).select(F.raise_error(F.lit("lost")).alias("n"))},
                  path, "y")
    assert read(spark, path) == [("x", 1)]
    assert sorted(r["run"] for r in lost_attempts(spark, path, "t").collect()) == ["x", "y", "z"]
    for _ in range(2):  # a commit that is repeated counts once
        commit(path, "x", attempt, {"t": numbers(spark)})
    assert read(spark, path) == [("x", 9)] and committed(spark, path).count() == 1


def test_runs_of_other_columns(spark, tmp_path):
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        write_run({"t": numbers(spark, 1)}, path, "x", form=form)
        write_run({"t": spark.createDataFrame([("a", 2)], "s string, n int")}, path, "y", form=form)
        write_run({"t": spark.createDataFrame([], "n int, more double")}, path, "z", form=form)
        rows = read_runs(spark, path, "t", form=form)
        assert rows.select("n", "s", "more", "run").orderBy("run").collect() == [(1, None, None, "x"), (2, "a", None, "y")]
    assert read_runs(spark, path, "t", "z", form="json").count() == 0


def test_a_run_needs_a_name(spark, tmp_path):
    with pytest.raises(ValueError):
        write_run({"t": numbers(spark, 1)}, str(tmp_path), "")


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("mine", "own", 1)], "run string, attempt string, n int")
    write_run({"t": rows}, str(tmp_path), "x")
    write_run({"t": rows.limit(0)}, str(tmp_path), "none")
    assert read(spark, str(tmp_path)) == [("x", 1)]


@pytest.fixture(scope="module")
def projects(spark, proverbs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("projects"))
    for n, name in enumerate(("1", "01", "two")):
        docs = proverbs.withColumn("text", F.substring_index("text", "\n", 4 + n))
        tables.save_documents(docs, path, name)
        tables.save_index(build_index(ingest(docs).passages), path, name)
    return path


def test_projects_do_not_leak(spark, projects):
    for n, name in enumerate(("1", "01", "two")):
        index = tables.load_index(spark, projects, name)
        assert index.passages.count() == index.lexical.passage_terms.count() == 4 + n
        assert index.lexical.corpus_stats.count() == 1
        assert index.lexical.corpus_stats.first()["n_passages"] == 4 + n


def test_several_projects_are_read_by_their_partitions(spark, projects):
    wanted = spark.createDataFrame([("01",), ("two",)], "project string")
    rows = tables.load_passages(spark, projects, wanted)
    assert {r["project_id"]: r["count"] for r in rows.groupBy("project_id").count().collect()} == {"01": 5, "two": 6}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    docs = tables.load_documents(spark, projects, wanted)
    assert sorted(r["project_id"] for r in docs.collect()) == ["01", "two"]
    assert tables.load_documents(spark, projects).count() == 3


def test_many_projects_in_one_write(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([("1", "a"), ("01", "b"), ("01", "c"), ("x/y", "d")], "project_id string, text string")
    tables.save_projects(first, path)
    tables.save_projects(spark.createDataFrame([("01", "new")], "project_id string, text string"), path)
    got = sorted((r["project_id"], r["text"]) for r in tables.load_documents(spark, path).collect())
    assert got == [("01", "new"), ("1", "a"), ("x/y", "d")]
    for bad in (None, ""):
        with pytest.raises(Exception, match="a run needs a name"):
            tables.save_projects(spark.createDataFrame([(bad, "a"), ("z", "b")], "project_id string, text string"), path)
    assert tables.load_documents(spark, path).count() == 3


def test_an_index_changes_as_a_whole(spark, projects, proverbs):
    docs = proverbs.withColumn("text", F.lit("Only one line."))
    index = build_index(ingest(docs).passages)
    broken = index.vectors.select("passage_id", F.raise_error(F.lit("lost")).cast("string").alias("vector"))
    with pytest.raises(Exception):
        tables.save_index(type(index)(index.passages, index.lexical, broken), projects, "two")
    held = tables.load_index(spark, projects, "two")
    assert held.passages.count() == held.vectors.count() == held.lexical.corpus_stats.first()["n_passages"] == 6


def test_labels_and_retries_of_results(spark, tmp_path):
    rows = spark.createDataFrame([("q1", 0.5, [1, 2]), ("q2", None, [])], "query_id string, mrr double, ranks array<int>")
    for label in ("1", "1.0", "1"):
        tables.save_results(rows, str(tmp_path), label)
    got = tables.read_results(spark, str(tmp_path), "1").orderBy("query_id").collect()
    assert [(r["query_id"], r["mrr"], r["ranks"], r["label"]) for r in got] == [
        ("q1", 0.5, [1, 2], "1"), ("q2", None, [], "1")]
    assert tables.read_results(spark, str(tmp_path)).count() == 4


def test_candidates_and_artifacts_of_a_named_run(spark, tmp_path):
    rows = spark.createDataFrame([("q", "p1", 0.5, 0.0, 0), ("q", "p2", 0.4, 0.9, 1)],
                                 "query_id string, passage_id string, hybrid_score double, rerank_score double, rank_rerank int")
    for _ in range(2):
        tables.save_candidates(rows, str(tmp_path / "c"), "batch 1")
        tables.save_artifact(rows, str(tmp_path), "bundles", "batch 1")
    got = tables.read_candidates(spark, str(tmp_path / "c")).collect()
    assert [(r["passage_id"], r["raw_score"], r["rank"]) for r in got] == [("p1", 0.5, 0), ("p2", 0.9, 1)]
    assert tables.read_artifact(spark, str(tmp_path), "bundles").count() == 2


def test_files_of_one_name(spark, tmp_path):
    for place in ("t/a", "t/b", "t"):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "x + ü.txt").write_text(place)
    got = {r["document_id"]: r["text"] for r in C.read_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"a/x + ü.txt": "t/a", "b/x + ü.txt": "t/b", "x + ü.txt": "t"}
    (one,) = C.read_texts(spark, str(tmp_path / "t" / "a" / "x + ü.txt")).collect()
    assert one["document_id"] == "x + ü.txt"
    by_pattern = C.read_texts(spark, str(tmp_path / "t" / "*" / "*.txt")).collect()
    assert len({r["document_id"] for r in by_pattern}) == 2
