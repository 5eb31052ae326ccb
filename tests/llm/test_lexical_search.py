"""Ranked search against scores of every document, taken one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from groundsieve.llm import lexical_search
from groundsieve.llm.lexical_search import BLOCK, PostingList, SearchOptions, Shard, ranked_documents, terms_of

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def by_hand(docs, items, k=10):
    held = [(key, Counter(terms(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (key, c), size in zip(held, sizes):
            if not size:
                continue
            m = 100 - 75 + (75 * size * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                (10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, rank, None if none else key, -score)
                for rank, (score, none, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, options=SearchOptions()):
    return sorted(map(tuple, ranked_documents(docs, items, options).collect()), key=repr)


def item_table(spark, items):
    rows = [(i, t, "x", 1) for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, term string, score int")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(st.one_of(st.sampled_from(" \n-aZ9@[`{\x7f\x80éİ東\x00"), st.characters(codec="utf-8"))), max_size=5))
def test_terms(texts):
    words, codes, offsets = terms_of(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])] == [terms(t) for t in texts]
    assert lexical_search._lengths(pa.array(texts, pa.string())).tolist() == [len(terms(t)) for t in texts]


def test_lists_are_unpacked_as_packed():
    rng = np.random.default_rng(3)
    shard = Shard(5000, 10**6)
    want = {}
    texts = []
    for doc in range(5000):
        row = []
        if doc % 3:
            row += ["often"] * int(rng.integers(1, 5))
        if doc % 700 == 1:
            row += ["seldom"] * (70_000 if doc == 1401 else 300)
        if doc == 4000:
            row += ["once"]
        texts.append(" ".join(row))
        for term, tf in Counter(row).items():
            want.setdefault(term, []).append((doc, tf))
    shard.add(pa.array(range(5000), pa.int64()), *terms_of(pa.array(texts)))
    first, *batches = shard.packed(9)
    m = np.frombuffer(first.column("documents")[0].as_py(), lexical_search._DOCUMENT)["m"].astype(np.int64)
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["term"] for r in rows] == sorted(want) and {r["shard"] for r in rows} == {9}
    for r in rows:
        held = PostingList(r["n"], np.frombuffer(r["firsts"], "<u2"), np.frombuffer(r["widths"], np.uint8),
                           np.frombuffer(r["maxima"], "<u4"), np.frombuffer(r["payload"], np.uint8), m)
        held.unpack(np.arange(len(held.firsts)))
        docs, tf = map(np.array, zip(*want[r["term"]]))
        parts = lexical_search.impacts(tf, m[docs])
        assert held.docs.tolist() == docs.tolist() and held.parts.tolist() == parts.tolist()
        assert held.maxima.tolist() == [parts[i: i + BLOCK].max() for i in range(0, len(docs), BLOCK)]


def corpus(seed, size):
    """Few words, so that scores tie; some documents many times; one word in most of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = []
    for i in range(size):
        text = " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 8, 30, 120])))
        docs.append((i * 7 % 1009, text if rng.random() < 0.8 or not docs else docs[-1][1]))
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("options", [
    SearchOptions(), SearchOptions(window=4), SearchOptions(k=1, window=1),
    SearchOptions(shard_documents=37, shard_postings=300, window=8, items=4, salts=2)])
def test_search(spark, options):
    docs, items = corpus(1, 1000)
    got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), item_table(spark, items), options)
    assert got == by_hand(docs, items, options.k)


def test_blocks_stay_packed(monkeypatch):
    """Lists of no weight are opened where a candidate could still get in, and nowhere else."""
    n = 40 * BLOCK
    shard = Shard(n, 20 * n)
    texts = [" ".join((["rare"] * 3 if d < 12 else []) + ["common"] + ["filler"] * (1 if d < 12 else 30)) for d in range(n)]
    shard.add(pa.array(range(n), pa.int64()), *terms_of(pa.array(texts)))
    first, *batches = shard.packed(0)
    m = np.frombuffer(first.column("documents")[0].as_py(), lexical_search._DOCUMENT)["m"].astype(np.int64)
    lists = {r["term"]: PostingList(r["n"], np.frombuffer(r["firsts"], "<u2"), np.frombuffer(r["widths"], np.uint8),
                                    np.frombuffer(r["maxima"], "<u4"), np.frombuffer(r["payload"], np.uint8), m)
             for b in batches for r in b.to_pylist()}
    docs, _ = lexical_search.search_shard([lists["common"], lists["rare"]], np.array([1, 9000]), n, SearchOptions(window=BLOCK))
    assert docs.tolist() == list(range(10))
    assert lists["common"].open.tolist() == [True] + [False] * 39


def test_messy(spark, messy, messy_rows):
    items = [(1, "word word one 東京 l'été"), (1, "word word one 東京 l'été"), (2, None), (3, ""), (4, "of no document zzzz"),
             (None, messy_rows[0][1]), (5, messy_rows[2][1] + " the one"), (6, "٣٤ it DON")]
    got = searched(messy, item_table(spark, items))
    want = by_hand(messy_rows, items)
    # Rows with one id are documents of their own; equal scores of one id have no order.
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert got == want


def test_nothing(spark, messy, nothing):
    items = item_table(spark, [(1, "word")])
    assert ranked_documents(nothing, items).count() == 0
    assert ranked_documents(messy, items.limit(0)).count() == 0
