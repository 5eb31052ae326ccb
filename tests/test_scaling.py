"""What keeps the shared steps of the queries in proportion to their input."""

import math
from collections import Counter
from contextlib import contextmanager
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundsieve.functions import tokenblocks
from groundsieve.functions.vectors import summed_codes
from groundsieve.operators.evidence import context_from_windows
from groundsieve.operators.lexical import term_counts
from groundsieve.plans.ingest import build_index, ingest
from groundsieve.plans.retrieval import assemble
from workload.data import Prepared, pair_scores

QUESTIONS = {"1": "Who shows mercy?", "2": "a lamp and a road"}


@pytest.fixture(scope="module")
def base(spark, proverbs):
    asked = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, question string")
    return Prepared(build_index(ingest(proverbs).passages), asked)


@contextmanager
def no_guessed_broadcast(spark):
    """Joins as they are for tables that are too big to broadcast unasked."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pair_scores_leave_the_passages_where_they_lie(spark, base):
    with no_guessed_broadcast(spark):
        assert "BroadcastHashJoin" in plan(pair_scores(base))


def test_reranked_candidates_are_scored_once(base):
    run = assemble(base.candidates, base.index, pair_scores=pair_scores(base))
    assert "Join" not in plan(run.reranked) and "Window" not in plan(run.reranked)
    assert run.reranked.count() == run.merged.where("rank_hybrid < 25").count()


def test_windows_of_few_anchors_are_not_shuffled(spark, proverbs):
    anchors = spark.createDataFrame([("q", "book-0"), ("q", "book-7")], "query_id string, passage_id string")
    with no_guessed_broadcast(spark):
        rows = context_from_windows(anchors, ingest(proverbs).windows)
        assert "SortMergeJoin" not in plan(rows) and rows.count() == 2


def test_a_text_that_is_its_own_normal_form_is_written_once(spark):
    given = [("a", "one two", "one two"), ("b", "One  two", "One two"), ("c", None, None), ("d", None, "x"),
             ("e", "x", None)]
    rows = spark.createDataFrame(given, "passage_id string, text string, normalized_text string")
    index = build_index(rows)
    assert {tuple(r) for r in index.passages.collect()} == set(given)
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in index.passages.inputFiles()})
    assert {r["passage_id"] for r in stored.where("normalized_text IS NOT NULL").collect()} == {"b", "d", "e"}


LISTS = [["b", "a", "b"], None, [], ["é", "z", "\U0001f600", "￿"], ["a"]]


def test_tokens_of_a_block_are_counted_by_row(values):
    expected = [None if x is None else sorted(Counter(x).items(), key=lambda p: p[0].encode()) for x in LISTS]
    got = values(term_counts, LISTS, "array<string>")
    assert [None if x is None else [tuple(e) for e in x] for x in got] == expected
    # A part of a block keeps to its own rows.
    part = tokenblocks.counted(pa.array([["q"], *LISTS], pa.list_(pa.string())).slice(1)).to_pylist()
    assert [None if x is None else [(e["term"], e["tf"]) for e in x] for x in part] == expected


def test_tokens_of_a_block_are_hashed_by_row():
    def code(word):
        h = sha256(word.encode()).digest()
        return (int.from_bytes(h[:4], "big") % 32 + 1) * (1 if h[4] % 2 == 0 else -1)

    got = tokenblocks.hashed(pa.array(LISTS, pa.list_(pa.string())), 32).to_pylist()
    assert got == [None if x is None else [code(w) for w in x] for x in LISTS]


def test_codes_of_a_block_are_summed_by_row(spark, values):
    codes = [[3, -1, 3, 5, -5], None, [], [2, -2], [-384]]
    root = math.sqrt(5)
    expected = [[(0, -1 / root), (2, 2 / root)], None, [], [], [(383, -1.0)]]
    got = values(summed_codes, codes, "array<int>")
    assert [None if x is None else [tuple(e) for e in x] for x in got] == expected
    rows = spark.createDataFrame([([1],)], "x array<int>").select(summed_codes(F.col("x")))
    assert "ArrowEvalPython" in plan(rows)


def test_a_block_is_moved_once_on_its_way_into_the_store_and_to_its_queries(spark, base, tmp_path):
    """The blocks come out of the task that sorted their passages; a search deals blocks out by range only."""
    from groundsieve.operators.lexical import bm25_search, prepare_questions
    from groundsieve.operators.postings import block_search, posting_tables, read_postings, write_postings

    blocks, ranges = posting_tables(base.index.lexical, 4, 8)
    assert "Exchange" not in plan(blocks) and "Exchange" not in plan(ranges)
    write_postings(base.index.lexical, str(tmp_path / "s"), 4, 8)
    asked = prepare_questions(base.questions)
    hits = block_search(read_postings(spark, str(tmp_path / "s")), asked, 3, 1).hits
    want = bm25_search(base.index.lexical, asked, 3).select("query_id", "passage_id", "lexical_score", "rank_lexical")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect())) != []


TEXTS = [
    "", "  ", None, "\u0130stanbul \u212aK a\xa0b\u2003c\u3000 d\x1c\x1de\x85f", "a  b   c \t d\t", "\n   x  \n y", "\u3000a\n\u3000",
    "ties is ses classes boxes running ing sing ring bring ed seed needed pies series quizzes watches gases buses dishes",
    "describes according Associated together x\u0301 \xc0\xc9\tt\r\nz \n \n\n\n q\r", "\u65e5\u672c \u8a9e\u3000\u5b57 Stra\xdfe 42nd a1b2s",
    "\x0b\n\x0c a \u2028\n b", "one two\nthree", "a\t\tb", "ends with blank ",
]


def test_one_pass_over_a_text_counts_and_hashes_as_the_columns_do(spark):
    """The block kernel gives what the column functions give, for each row."""
    from groundsieve.functions.text import lexical_tokens
    from groundsieve.functions.vectors import hash_codes
    from groundsieve.operators.lexical import index_columns, token_length

    rows, text = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1), F.col("text")
    for compat in (False, True):
        tokens = lexical_tokens(text, compat)
        got = rows.select(
            text, F.size(tokens).alias("length"), term_counts(tokens).alias("entries"), hash_codes(text).alias("vector"),
            index_columns(text, compat, 384).alias("one")).select("*", token_length("one.length").alias("n"))
        for r in got.collect():
            assert (r["n"], r["one"]["entries"], r["one"]["vector"]) == (r["length"], r["entries"], r["vector"]), r["text"]


def test_an_index_is_one_pass_over_the_passages(spark):
    """Tokens are cut in one Python pass for terms and vectors, not by one for each."""
    from groundsieve.plans.ingest import build_index

    rows = spark.createDataFrame([("p", "Wa wb")], "passage_id string, normalized_text string")
    index = build_index(rows, staged=False)
    plan = index.passages.join(index.vectors, "passage_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    assert index.lexical.passage_terms._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_white_space_as_the_plain_patterns_have_it(values):
    from groundsieve.functions.text import SPACE, blank_tokens, nfc, normalize_text, strip, token_count

    def normalized(text):
        out = F.regexp_replace(F.regexp_replace(nfc(text), r"\r\n?", "\n"), r"[ \t]+", " ")
        blank = r"[\s\x1c-\x1f&&[^\n]]*"
        return strip(F.regexp_replace(F.regexp_replace(out, rf"(?U){blank}\n{blank}", "\n"), r"\n{3,}", "\n\n"))

    def words(text):
        return F.array_remove(F.split(text, rf"(?U){SPACE}+"), "")

    assert values(normalize_text, TEXTS) == values(normalized, TEXTS)
    assert values(blank_tokens, TEXTS) == values(words, TEXTS)
    assert values(token_count, TEXTS) == values(lambda t: F.size(words(t)), TEXTS)


def test_rows_in_one_row_group_are_spread(spark, tmp_path, monkeypatch):
    """A file of one row group goes to all cores at any size; files that fill the cores stay as they are."""
    from groundsieve.sources import staging

    monkeypatch.setattr(staging, "_SMALL_SPLIT", 1000)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(4000).coalesce(1).write.parquet(one)
    spark.range(4000).repartition(8).write.parquet(many)

    def moved(path):
        rows = staging.spread(spark.read.parquet(path), "id")
        assert rows.distinct().count() == 4000
        return "Exchange" in rows._jdf.queryExecution().executedPlan().toString()

    assert moved(one)
    monkeypatch.setattr(staging, "_SMALL_SPLIT", 0)
    assert not moved(many)
