"""The posting store against the search that scores every passage."""

import random

import pytest
from pyspark.sql import functions as F

from groundsieve.operators.lexical import bm25_search, build_lexical_index, prepare_questions
from groundsieve.operators.postings import asked_blocks, block_search, read_postings, write_postings
from groundsieve.operators.lexical import query_weights

rng = random.Random(11)
WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(10)]
WEIGHTS = [1 / (i + 1) for i in range(len(WORDS))]


def text(words):
    return " ".join(rng.choices(WORDS, WEIGHTS, k=words) + ["grain"])


PASSAGES = [(f"{d}-{i}", text(rng.choice([0, 3, 9, 30]))) for d in range(60) for i in range(15)]
# Some passages are alike, so scores tie.
PASSAGES += [(f"x-{i}", PASSAGES[i % 5][1]) for i in range(40)]
QUESTIONS = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))) for i in range(30)] + [
    ("none", "the what"), ("unknown", "zzzz"), ("all", "grain"), ("empty", "")]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(PASSAGES, "passage_id string, normalized_text string").repartition(3)
    return build_lexical_index(rows).staged()


@pytest.fixture(scope="module")
def store(spark, index, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "store")
    write_postings(index, path, buckets=16, size=64)
    return read_postings(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    return prepare_questions(spark.createDataFrame(QUESTIONS, "query_id string, question string"))


@pytest.mark.parametrize("k, seeds, at_once", [(10, 4, 2048), (1, 1, 2048), (3, 2, 5), (2000, 1, 7)])
def test_same_hits(index, store, queries, k, seeds, at_once):
    got = block_search(store, queries, k, seeds, at_once)
    want = bm25_search(index, queries, k)
    assert sorted(map(tuple, got.hits.collect())) == sorted(map(tuple, want.select(
        "query_id", "passage_id", "lexical_score", "rank_lexical").collect()))


def test_blocks_hold_all_postings(store, index):
    rows = store.blocks.select("term", "range", F.posexplode(F.arrays_zip("slots", "parts")).alias("i", "p")).join(
        store.ranges, "range").select("term", F.get("passage_ids", F.col("p.slots")).alias("passage_id"))
    assert sorted(map(tuple, rows.collect())) == sorted(
        (r["term"], r["passage_id"]) for r in index.postings.collect())
    sizes = store.blocks.select(F.max("n"), F.min(F.col("largest") - F.array_max("parts"))).first()
    assert sizes[0] <= 64 and sizes[1] == 0
    ids = [i for r in store.ranges.orderBy("range").collect() for i in r["passage_ids"]]
    assert ids == sorted(p for p, _ in PASSAGES)


def test_ranges_are_skipped(spark, store):
    """A word of one range: the others hold common words only and cannot reach the bar."""
    asked = prepare_questions(spark.createDataFrame([("q", f"{WORDS[-1]} {WORDS[-2]} {WORDS[0]}")], "query_id string, question string"))
    (row,) = block_search(store, asked, 1, seeds=1).report.collect()
    assert 0 < row["n_ranges_read"] < row["n_ranges"] and row["n_blocks_read"] < row["n_blocks"]


def test_only_files_of_asked_terms_are_read(spark, store):
    asked = prepare_questions(spark.createDataFrame([("q", f"{WORDS[1]} {WORDS[3]}")], "query_id string, question string"))
    rows = asked_blocks(store, query_weights(store.index, asked))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan
    files = {f for r in rows.select("_metadata.file_path").collect() for f in r}
    buckets = {f.split("bucket=")[1].split("/")[0] for f in files}
    assert 1 <= len(buckets) <= 2 and {r["term"] for r in rows.collect()} <= {WORDS[1], WORDS[3]}
    # Bounds are read without the postings themselves.
    names = rows.select("term", "range", "largest")._jdf.queryExecution().executedPlan().toString()
    assert "slots" not in names and "parts" not in names


def test_an_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([], "passage_id string, normalized_text string")
    write_postings(build_lexical_index(rows), str(tmp_path / "s"))
    store = read_postings(spark, str(tmp_path / "s"))
    asked = prepare_questions(spark.createDataFrame([("q", "word")], "query_id string, question string"))
    assert block_search(store, asked, 5).hits.count() == 0
    with pytest.raises(ValueError):
        write_postings(build_lexical_index(rows), str(tmp_path / "t"), size=100)
