"""BM25 and dense search against plain Python over a small corpus."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundsieve.functions.vectors import cosine, hash_codes, l2_normalize
from groundsieve.operators.dense import build_hash_index, dense_search, embed_questions, hash_embedding
from groundsieve.operators.lexical import (
    bm25_scores, bm25_search, build_lexical_index, prepare_questions,
)

rng = random.Random(7)
WORDS = ["stone", "river", "bread", "lamp", "horse", "salt", "wheel", "grain", "tower", "cloud"]
# "grain" stands in most passages, so its idf is negative and gets the floor.
TEXTS = {
    f"p{n:02d}": " ".join(rng.choices(WORDS, k=rng.randint(0, 9)) + ["grain"] * (n % 4 > 0))
    for n in range(40)
}
QUESTIONS = {"q1": "river stone grain", "q2": "lamp lamp horse", "q3": "the what is",
             "q4": "unknown words", "q5": "grain", "q6": "salt wheel tower cloud bread"}


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(list(TEXTS.items()), "passage_id string, normalized_text string")


@pytest.fixture(scope="module")
def index(passages):
    return build_lexical_index(passages).staged()


@pytest.fixture(scope="module")
def queries(spark):
    rows = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, question string")
    return prepare_questions(rows)


def plain_scores(query_terms):
    docs = {p: [w for w in t.split()] for p, t in TEXTS.items()}
    n = len(docs)
    mean_length = sum(map(len, docs.values())) / n
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for p, d in docs.items():
        tf = Counter(d)
        out[p] = round(sum(
            (floor if raw[w] < 0 else raw[w]) * tf[w] * 2.5
            / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean_length))
            for w in query_terms if w in raw), 6)
    return out


def plain_top(k, padded):
    expected = set()
    for q, question in QUESTIONS.items():
        terms = [] if q == "q3" else list(dict.fromkeys(question.split()))
        scores = plain_scores(terms)
        order = sorted(scores, key=lambda p: (-scores[p], p))
        order = [p for p in order if padded or scores[p] > 0][:k]
        expected |= {(q, p, scores[p], r) for r, p in enumerate(order)}
    return expected


def rows(df):
    return {tuple(r) for r in df.collect()}


def close(got, expected):
    def key(r):
        return (r[0], r[-1])

    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [(g[0], g[1], g[3]) for g in got] == [(e[0], e[1], e[3]) for e in expected]
    assert all(abs(g[2] - e[2]) < 2e-6 for g, e in zip(got, expected))


def test_index_tables(index):
    stats = index.corpus_stats.first()
    lengths = [len(t.split()) for t in TEXTS.values()]
    assert stats["n_passages"] == 40 and abs(stats["mean_length"] - sum(lengths) / 40) < 1e-9
    df = Counter(w for t in TEXTS.values() for w in set(t.split()))
    assert {r["term"]: r["df"] for r in index.term_stats.collect()} == dict(df)
    tf = {(p, w): n for p, t in TEXTS.items() for w, n in Counter(t.split()).items()}
    assert {(r["passage_id"], r["term"]): r["tf"] for r in index.postings.collect()} == tf


@pytest.mark.parametrize("k", [1, 5, 100])
def test_bm25_top_k(index, queries, k):
    close(rows(bm25_search(index, queries, k)), plain_top(k, padded=False))


def test_bm25_compat_pads_with_zero_scores(index, queries):
    got = rows(bm25_search(index, queries, 30, compat=True))
    close(got, plain_top(30, padded=True))
    assert len(got) == 30 * len(QUESTIONS)


@pytest.mark.parametrize("compat", [False, True])
def test_bm25_grid_of_blocks_gives_the_same(index, queries, compat):
    local = rows(bm25_search(index, queries, 7, compat=compat))
    assert rows(bm25_search(index, queries, 7, compat=compat, local_queries=2, cell_passages=9)) == local


@pytest.mark.parametrize("broadcast_rows", [None, 1])
def test_relational_scores_agree(index, queries, broadcast_rows):
    got = rows(bm25_scores(index, queries, salts=3, broadcast_rows=broadcast_rows).where(
        "lexical_score > 0"))
    expected = {(q, p): s for q, p, s, _ in plain_top(100, padded=False)}
    assert {(q, p) for q, p, _ in got} == set(expected)
    assert all(abs(s - expected[q, p]) < 2e-6 for q, p, s in got)


def test_repeated_query_terms_count_repeatedly(spark, index):
    asked = spark.createDataFrame([("a", ["lamp"]), ("b", ["lamp", "lamp"])],
                                  "query_id string, search_terms array<string>")
    best = {r["query_id"]: r["lexical_score"] for r in bm25_search(index, asked, 1).collect()}
    assert abs(best["b"] - 2 * best["a"]) < 3e-6


def test_order_and_partitioning_do_not_matter(passages, queries):
    one = build_lexical_index(passages.coalesce(1))
    many = build_lexical_index(passages.orderBy(F.xxhash64("passage_id")).repartition(8))
    assert rows(bm25_search(one, queries, 9)) == rows(bm25_search(many, queries, 9))
    left = dense_search(build_hash_index(passages.coalesce(1)), embed_questions(queries), 9)
    right = dense_search(build_hash_index(passages.repartition(8)), embed_questions(queries), 9)
    assert rows(left) == rows(right)


def plain_vector(text, dims):
    out = [0] * dims
    for token in text.lower().split():
        h = hashlib.sha256(token.encode()).digest()
        out[int.from_bytes(h[:4], "big") % dims] += 1 if h[4] % 2 == 0 else -1
    return out


def plain_cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else 0.0


@pytest.mark.parametrize("dims", [32, 384])
def test_hash_codes(values, dims):
    texts = ["Patience is a virtue", "", "x x x", "Ünï code"]
    for text, codes in zip(texts, values(lambda c: hash_codes(c, dims), texts)):
        vector = [0] * dims
        for c in codes:
            vector[abs(c) - 1] += 1 if c > 0 else -1
        assert vector == plain_vector(text, dims)


def test_hash_embedding_has_unit_length(passages):
    weights = hash_embedding(build_hash_index(passages))
    sums = weights.groupBy("passage_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert sums and all(abs(r["s"] - 1) < 1e-9 for r in sums)


@pytest.mark.parametrize("k", [3, 100])
def test_dense_top_k(passages, queries, k):
    got = rows(dense_search(build_hash_index(passages), embed_questions(queries), k))
    expected = set()
    for q, question in QUESTIONS.items():
        scores = {p: plain_cosine(plain_vector(question, 384), plain_vector(t, 384))
                  for p, t in TEXTS.items()}
        order = sorted(scores, key=lambda p: (-scores[p], p))[:k]
        expected |= {(q, p, scores[p] + 0.0, r) for r, p in enumerate(order)}
    assert got == expected


def test_dense_grid_gives_the_same(passages, queries):
    vectors, asked = build_hash_index(passages), embed_questions(queries)
    assert rows(dense_search(vectors, asked, 5, local_queries=2, cell_passages=9)) == rows(
        dense_search(vectors, asked, 5))


def test_given_vectors_and_zero_vectors(spark):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [3.0, 4.0]), ("d", [-1.0, 0.0])],
        "passage_id string, vector array<float>")
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0])],
                                  "query_id string, vector array<float>")
    got = dense_search(vectors, asked, 3, dims=2, hashed=False).orderBy("query_id", "rank_dense")
    assert [tuple(r) for r in got.collect()] == [
        ("q", "a", 1.0, 0), ("q", "c", 0.6, 1), ("q", "b", 0.0, 2),
        ("z", "a", 0.0, 0), ("z", "b", 0.0, 1), ("z", "c", 0.0, 2)]


def test_l2_normalize_and_cosine(spark, values):
    got = values(l2_normalize, [[3.0, 4.0], [0.0, 0.0]], "array<float>")
    assert [round(x, 9) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0]
    pair = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
                                 "a array<double>, b array<double>")
    got = [r["c"] for r in pair.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and got[1] == 0.0


def test_searches_never_build_pairs(index, queries):
    plan = bm25_search(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
