"""Scores against a word-by-word form, and that training helps."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from groundsieve.llm import lm_scoring
from groundsieve.llm.lm_scoring import Network, WindowOptions
from llm_tools import documents

SMALL = WindowOptions(context_bits=6, word_bits=8, classes=8, width=6, batch=64, first_words=700, shard_words=1500, rounds=3)


@pytest.fixture(scope="module")
def chains():
    """Texts in which each word follows from its neighbours."""
    rng, rows = random.Random(4), []
    for i in range(120):
        start = rng.randrange(12)
        rows.append((i, " ".join(f"word{(start + k) % 12}" for k in range(60))))
    return rows


def word_by_word(text, net, classes, shares, o):
    word, near, _ = lm_scoring.places(pa.array([text], pa.string()), o)
    total = 0.0
    for i in range(len(word)):
        h = net.bias.astype(float).copy()
        for table, step in zip(net.tables, o.offsets):
            j = i + step
            h += table[near[j] if 0 <= j < len(word) else len(table) - 1]
        logits = np.tanh(h) @ net.out + net.out_bias
        c = classes[word[i]]
        total += logits[c] - np.log(np.exp(logits).sum()) + shares[word[i]]
    return len(word), total


def test_scores_and_training(spark, chains, messy_rows):
    frame = documents(spark, chains)
    counts = lm_scoring.count_words(frame, SMALL)
    assert counts.sum() == 120 * 60
    classes, shares = lm_scoring.word_classes(counts, SMALL)
    net = lm_scoring.train(frame, classes, SMALL)
    both = documents(spark, [*chains[:5], *messy_rows])
    got = lm_scoring.score(both, net, classes, shares, SMALL).collect()
    want = [(i, *word_by_word(t, net, classes, shares, SMALL)) for i, t in [*chains[:5], *messy_rows]]
    key = lambda r: (r[1], round(r[2], 1), repr(r[0]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.02)
        assert (a[3] is None) == (a[1] == 0) and (a[1] == 0 or a[3] == pytest.approx(a[2] / a[1]))
    # The neighbours tell the word: far better than its frequency.
    before = sum(word_by_word(t, Network.start(SMALL), classes, shares, SMALL)[1] for _, t in chains[:3])
    after = sum(word_by_word(t, net, classes, shares, SMALL)[1] for _, t in chains[:3])
    assert after / 180 > before / 180 + 0.5


def test_every_word_is_predicted_once_in_all_rounds(spark, messy, messy_rows, monkeypatch):
    """With the settings of the registered query, and with many shards."""
    seen = []
    monkeypatch.setattr(lm_scoring, "_averaged", lambda rows, shards, state, classes, o: seen.append(rows.collect()))
    for o in (WindowOptions(), WindowOptions(shard_words=300)):
        seen.clear()
        rows = lm_scoring.coded(messy, o)
        words = int(lm_scoring.count_coded(rows, o).sum())
        assert words == sum(len(lm_scoring.places(pa.array([t or ""]), o)[0]) for _, t in messy_rows)
        lm_scoring.train_coded(rows, words, np.zeros(1 << o.word_bits, int), o)
        first, *rounds = seen
        assert sorted(bytes(r.words) for part in rounds for r in part) == sorted(bytes(r.words) for r in rows.collect())
        assert len(rounds) == o.rounds and sum(len(r.words) for r in first) <= 2 * words


def test_scores_do_not_depend_on_partitions(spark, chains):
    o = WindowOptions(context_bits=6, word_bits=8, classes=8, width=6, batch=64, first_words=700, shard_words=1500, rounds=3)
    scores = []
    for partitions in (1, 8, 64):
        rows = lm_scoring.pseudo_likelihoods(documents(spark, chains).repartition(partitions), o).collect()
        scores.append(np.array([r.pll_per_word for r in sorted(rows, key=lambda r: r.doc_id)]))
    assert np.abs(scores[0] - scores[1]).max() < 1e-3 and np.abs(scores[0] - scores[2]).max() < 1e-3


def test_averaging_teaches_more_than_one_shard(spark):
    """On text that was not learnt from: better than word frequencies, and than one shard alone."""
    rng, rows = random.Random(8), []
    steps = {w: [rng.randrange(200) for _ in range(3)] for w in range(200)}
    for i in range(600):
        word, text = rng.randrange(200), []
        for _ in range(60):
            text.append(f"w{word}")
            word = rng.choice(steps[word])
        rows.append((i, " ".join(text)))
    o = WindowOptions(context_bits=10, word_bits=12, classes=32, width=16, batch=256, first_words=1500, shard_words=4000)
    learnt, held = documents(spark, rows[:500]), documents(spark, rows[500:])
    classes, shares = lm_scoring.word_classes(lm_scoring.count_words(learnt, o), o)

    def likelihood(net):
        return np.mean([r.pll_per_word for r in lm_scoring.score(held, net, classes, shares, o).collect()])

    every = likelihood(lm_scoring.train(learnt, classes, o))
    alone = likelihood(lm_scoring.train(documents(spark, rows[:66]), classes, o))
    untaught = Network(*[p * 0 for p in Network.start(o).parts()])  # all classes alike: word frequencies
    assert every > alone + 0.05 and every > likelihood(untaught) + 0.3


def test_classes_cut_all_words_evenly():
    counts = np.array([100, 100, 50, 50, 25, 25, 25, 25, 0] + [0] * 247)
    classes, shares = lm_scoring.word_classes(counts, WindowOptions(word_bits=8, classes=4, smoothing=1e-6))
    assert np.allclose([np.exp(shares[classes == c]).sum() for c in range(4)], 1)
    assert classes[:4].tolist() == [0, 1, 2, 2]


def test_messy_and_nothing(messy, messy_rows, nothing):
    assert lm_scoring.pseudo_likelihoods(messy, SMALL).count() == len(messy_rows)
    assert lm_scoring.pseudo_likelihoods(nothing, SMALL).count() == 0
