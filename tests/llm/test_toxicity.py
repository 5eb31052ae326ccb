"""Held-out accuracy, and what a score may not depend on."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from groundsieve.llm import toxicity
from groundsieve.llm.toxicity import FtrlOptions
from llm_tools import documents, prose

BAD = [f"vile{k}" for k in range(20)]
LABELS = "doc_id long, quality int, toxic int, text string, score double"


@pytest.fixture(scope="module")
def corpus():
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        words = prose(rng, 2, 20).split(" ")
        toxic = int(i % 5 == 0)
        for _ in range(rng.randint(2, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic, "z", 0.0))
    return rows, labels


def out_of_sample(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def scores(spark, rows, labels):
    table = toxicity.toxicity_table(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    return {r.doc_id: r for r in table.collect()}


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    got = scores(spark, rows, labels)
    held = [(l[2], got[l[0]]) for l in labels if out_of_sample(l[0])]
    assert all(got[i].held_out == out_of_sample(i) for i, _ in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([t == r.predicted for t, r in held]) > 0.95


def test_held_out_labels_do_not_count(spark, corpus):
    rows, labels = corpus
    flipped = [(i, 1 - q, 1 - t if out_of_sample(i) else t, x, s) for i, q, t, x, s in labels]
    a, b = scores(spark, rows, labels), scores(spark, rows, flipped)
    assert all(a[i].score == b[i].score for i in a)


def test_scores_are_of_the_whole_text(spark, corpus):
    rows, labels = corpus
    long = prose(random.Random(1), 900, 20)
    got = scores(spark, [*rows, (5000, long), (5001, long + " " + " ".join(BAD[:6]))], labels)
    assert got[5001].score > got[5000].score


def test_messy(spark, messy, messy_rows, nothing):
    labels = [(1, 1, 1, "a", 0.0), (1, 1, 0, "b", 0.0), (2, 0, None, "c", 0.0), (None, 0, 1, "d", 0.0), (99, 1, 1, "e", 0.0)]
    table = spark.createDataFrame(labels, LABELS)
    rows = toxicity.toxicity_table(messy, table).collect()
    assert len(rows) == len(messy_rows)
    assert all(r.score is not None and (r.doc_id is not None or r.held_out) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1  # without words
    assert len({r.score for r in rows if r.doc_id in (1, 7)}) == 1
    assert toxicity.toxicity_table(nothing, table).count() == 0
    assert toxicity.toxicity_table(messy, table.where("false")).count() == len(messy_rows)


def test_features_and_ftrl():
    places, owners = toxicity.feature_places(pa.array(["a b c d", None, "a"]), 20)
    assert np.bincount(owners, minlength=3).tolist() == [4 + 3 + 2 + 1, 0, 1]
    options = FtrlOptions(bits=4, l1=1.0, alpha=1.0)
    weights, bias = toxicity.fit_ftrl([(np.array([1, 2]), 1), (np.array([2, 3]), 0)] * 40, options)
    assert weights[1] > 0 > weights[3] and abs(weights[2]) < 0.5 and not weights[[0, 4, 5]].any()
