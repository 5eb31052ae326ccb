"""Planted benchmark texts, altered ones and clean documents."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from groundsieve.llm import decontamination as dec
from groundsieve.llm.decontamination import LeakOptions
from llm_tools import documents, prose, sentence

BENCH = "item_id long, text string, doc_id string, answer string"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(21)
    common = sentence(rng, 30).lower().rstrip(".").split()  # words that all texts share

    def text(words):
        w = [rng.choice(common) if rng.random() < 0.4 else sentence(rng, 1).lower().rstrip(".") for _ in range(words)]
        return " ".join(w).capitalize() + "."

    items = [(k, "\n".join(text(rng.randint(8, 25)) for _ in range(rng.randint(1, 3)))) for k in range(40)]
    rows, want = [], set()
    for i in range(200):
        lines = [text(rng.randint(10, 60)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            item = i // 4 % 40
            words = items[item][1].split()
            if i % 8 == 0:  # an altered copy: one word in ten is another one
                words = [w if rng.random() > 0.1 else "other" for w in words]
            else:
                words = [w.upper() if rng.random() < 0.3 else w for w in words]
            kept = [a == b.lower() or a.lower() == b.lower() for a, b in zip(items[item][1].split(), words)]
            if sum(kept) >= 0.8 * len(kept):
                want.add((i, item))
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        rows.append((i, " ".join(lines)))
    return rows, items, want


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], BENCH)


def found(frame, items):
    return {(r.doc_id, r.item_id) for r in dec.leaks(frame, items).collect()}


def test_planted_texts_are_found_and_others_are_not(spark, planted):
    rows, items, want = planted
    got = found(documents(spark, rows), bench(spark, items))
    assert want <= got
    assert {i for i, _ in got} <= {i for i, _ in rows if i % 4 == 0}


def test_blocks_of_the_benchmark_give_the_same(spark, planted):
    rows, items, want = planted
    out = dec.leaks(documents(spark, rows[:80]), bench(spark, items), LeakOptions(items_per_pass=15))
    assert {w for w in want if w[0] < 80} <= {(r.doc_id, r.item_id) for r in out.collect()}


def test_an_answer_word_for_word_makes_up_for_a_changed_question(spark):
    rng = random.Random(8)
    question, answer = sentence(rng, 20), sentence(rng, 10)
    item = [(1, f"{question}\n{answer}")]
    changed = question.split()
    for k in (1, 4, 7, 9, 12, 15, 17, 18):  # 22 of 30 words are left
        changed[k] = f"word{k}"
    broken = answer.split()
    broken[4] = "broken"
    rest = [(10 + k, prose(rng, 3)) for k in range(20)]
    rows = [(1, " ".join([sentence(rng, 30), *changed, answer])), (2, " ".join([*changed, *broken])), *rest]
    got = {r.doc_id: r for r in dec.leaks(documents(spark, rows), bench(spark, item)).collect()}
    assert set(got) == {1} and got[1].answer and 0.6 <= got[1].lcs < 0.8


def test_messy(spark, messy, messy_rows):
    items = [(1, messy_rows[0][1]), (1, messy_rows[0][1]), (2, None), (3, ""), (4, "?! ..."), (None, "lost text here"),
             (5, "one two"), (6, "never there")]
    got = [(r.doc_id, r.item_id) for r in dec.leaks(messy, bench(spark, items)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (7, 1), (None, 1), (10, 1), (6, 5)], key=repr)
    kept = dec.without_leaks(messy, dec.leaks(messy, bench(spark, items)))
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in messy_rows if i not in (1, 6, 7, 10))


def test_nothing(spark, nothing, messy):
    none = spark.createDataFrame([], BENCH)
    assert dec.leaks(messy, none).count() == 0
    assert dec.leaks(nothing, bench(spark, [(1, "some benchmark text of a few words")])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    assert dec.lcs_length(dec._masks(np.array(a, int)), len(a), b) == row[-1]


def test_space_of_known_rank():
    """With all singular vectors kept, projections keep the angles of TF-IDF passages."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(12)], 9)) for _ in range(60)]
    held = dec.read_benchmark(pa.table({"item_id": list(range(60)), "text": texts}))
    options = LeakOptions(rank=12, oversampling=8, block=8)
    grid, _ = dec._grid(np.concatenate(held.words), np.arange(0, 541, 9), 9, 12)
    _, passages, squares, sample = dec.gram_sample(grid, dec._random(12, options))
    space, _ = dec.semantic_space(60, passages, squares, sample, held, options)
    counts = np.stack([np.bincount(w, minlength=12) for w in held.words])
    idf = np.maximum(np.log(61 / (passages + 0.5)), 0.05)
    full, small = counts * idf, counts @ space
    cosine = lambda x: (x @ x.T) / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(cosine(full), cosine(small), atol=1e-3)
