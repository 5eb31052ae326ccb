"""An index that is changed bit by bit against one that is built afresh."""

import random

import pytest
from pyspark.sql import functions as F

from groundsieve.operators.lexical import bm25_search, prepare_questions
from groundsieve.plans.ingest import build_index, ingest
from groundsieve.plans.segments import compact_segments, create_segments, open_segments, segments, update_segments
from groundsieve.sources import commits

SCHEMA = "document_id string, text string, sectioning_strategy string, passage_strategy string"
rng = random.Random(5)
WORDS = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]


def text():
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5)))


def table(spark, docs):
    return spark.createDataFrame([(k, v, "paragraph", "natural_units") for k, v in docs.items()], SCHEMA)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def content(index):
    stats = index.lexical.corpus_stats.first().asDict()
    return (
        sorted((r["passage_id"], r["text"], r["document_id"]) for r in index.passages.collect()),
        sorted((r["passage_id"], r["length"], tuple(sorted(map(tuple, r["entries"])))) for r in index.lexical.passage_terms.collect()),
        sorted(map(tuple, index.lexical.term_stats.select("term", "df").collect())),
        sorted((r["passage_id"], tuple(r["vector"])) for r in index.vectors.collect()),
        stats["n_passages"], *(None if stats[c] is None else round(stats[c], 9) for c in ("mean_length", "mean_idf")))


def same(spark, path, docs):
    got, want = open_segments(spark, path), build_index(ingest(table(spark, docs)).passages)
    assert content(got) == content(want)
    return got, want


def test_changes(spark, tmp_path):
    path, docs = str(tmp_path / "s"), {f"d{i}": text() for i in range(12)}
    create_segments(table(spark, docs), path)
    same(spark, path, docs)

    change = {"d3": text(), "d4": "", "new1": text()}  # a changed one, one without passages, a new one
    update_segments(path, table(spark, change), ids(spark, "d5", "never there"))
    docs |= change
    del docs["d5"]
    same(spark, path, docs)

    change = {"d3": text(), "d5": text()}  # changed once more, and back again
    number = update_segments(path, table(spark, change), ids(spark, "d0", "d1"))
    docs |= change
    del docs["d0"], docs["d1"]
    got, want = same(spark, path, docs)
    asked = prepare_questions(spark.createDataFrame([("q", "wa wb wc"), ("r", "wz")], "query_id string, question string"))
    assert sorted(map(tuple, bm25_search(got.lexical, asked, 5).collect())) == sorted(
        map(tuple, bm25_search(want.lexical, asked, 5).collect()))

    # The same change again under its number changes nothing.
    assert update_segments(path, table(spark, change), ids(spark, "d0", "d1"), number) == number
    same(spark, path, docs)
    assert len(segments(spark, path)) == 3

    compact_segments(spark, path)
    same(spark, path, docs)
    assert len(segments(spark, path)) == 1
    update_segments(path, table(spark, {"d9": "wq"}), ids(spark, "d2"))
    docs["d9"] = "wq"
    del docs["d2"]
    same(spark, path, docs)


def test_a_killed_change_does_not_count(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "s"), {"a": "wa wb", "b": "wc"}
    create_segments(table(spark, docs), path)

    def killed(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", killed)
        with pytest.raises(RuntimeError):
            update_segments(path, table(spark, {"a": "wz"}))
        with pytest.raises(RuntimeError):
            compact_segments(spark, path)
    same(spark, path, docs)
    update_segments(path, table(spark, {"a": "wy"}))
    same(spark, path, {"a": "wy", "b": "wc"})


def test_all_documents_removed(spark, tmp_path):
    path = str(tmp_path / "s")
    create_segments(table(spark, {"a": "wa"}), path)
    update_segments(path, table(spark, {"b": "wb"}).limit(0), ids(spark, "a"))
    index = open_segments(spark, path)
    assert index.passages.count() == index.lexical.term_stats.count() == 0
    assert index.lexical.corpus_stats.first()["n_passages"] == 0
    update_segments(path, table(spark, {"c": "wc"}))
    same(spark, path, {"c": "wc"})


def test_only_changed_documents_are_split(spark, tmp_path):
    """The plan of a change reads the text of the changed documents, not of the stored passages."""
    path, docs = str(tmp_path / "s"), {f"d{i}": text() for i in range(5)}
    create_segments(table(spark, docs), path)
    from groundsieve.plans.segments import _live

    old = _live(spark, path, "passage_terms")
    assert "text" not in old.columns and "normalized_text" not in old._jdf.queryExecution().executedPlan().toString()
    assert old.select(F.countDistinct("document_id")).first()[0] == 5


def test_a_change_is_split_and_counted_in_one_pass(spark):
    """Passages, terms and vectors of a change come out of the pass that splits it, without joins or shuffles."""
    from groundsieve.config import RetrievalConfig
    from groundsieve.plans.segments import _rows

    rows = _rows(table(spark, {"a": "wa wb\nwc", "b": "wd"}), RetrievalConfig(), 384)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert plan.count("Generate explode") + plan.count("Generate posexplode") == 1
    assert {"text", "indexed", "copies"} <= set(rows.columns) and rows.count() == 3


def test_documents_that_come_twice(spark, tmp_path):
    """Terms and vectors stand once for each pair of passages of one id, before and after other changes."""
    path = str(tmp_path / "s")
    docs = table(spark, {"a": "wa wb\nwc", "b": "wd"}).union(table(spark, {"a": "we"})).union(
        table(spark, {None: "wf"}))
    create_segments(docs, path)

    def terms(index):
        return sorted((r["passage_id"], r["entries"][0]["term"]) for r in index.lexical.passage_terms.collect())

    for _ in range(2):
        index = open_segments(spark, path)
        assert terms(index) == [("a-0", "wa"), ("a-0", "wa"), ("a-0", "we"), ("a-0", "we"), ("a-1", "wc"), ("b-0", "wd")]
        assert index.vectors.count() == 6 and index.passages.count() == 5
        assert index.lexical.corpus_stats.first()["n_passages"] == 6
        compact_segments(spark, path)
    update_segments(path, table(spark, {"a": "wg"}))
    index = open_segments(spark, path)
    assert terms(index) == [("a-0", "wg"), ("b-0", "wd")]
    assert index.lexical.corpus_stats.first()["n_passages"] == 2
    assert sorted(r["term"] for r in index.lexical.term_stats.collect()) == ["wd", "wg"]


def test_ids_that_a_condition_of_the_documents_cannot_read(spark, tmp_path):
    """Documents filtered by the number in their id, beside others that come twice and have no number."""
    path, n = str(tmp_path / "s"), F.col("document_id").cast("int") % 10
    docs = spark.createDataFrame([(str(i % 9), f"w{i}", "paragraph", "natural_units") for i in range(12)], SCHEMA)
    copies = docs.where(n == 1).withColumn("document_id", F.concat(F.lit("copy-"), "document_id"))
    create_segments(docs.where(n != 3).unionByName(copies), path)
    assert open_segments(spark, path).passages.count() == 13
    update_segments(path, docs.where(n == 3), copies)
    assert open_segments(spark, path).passages.count() == 12
