"""Bounds on the number of sequences, and rounds of bounded partitions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from groundsieve.llm.packing import PackingOptions, best_fit_decreasing, bin_bound, pack


def pieces(spark, lengths):
    return spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")


def packed(spark, lengths, options):
    rows = pack(pieces(spark, lengths), options).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= options.capacity
    return rows


def test_bound_certifies_two_and_three_a_sequence():
    assert bin_bound(np.full(3000, 1500), 4096) == 1500
    assert bin_bound(np.full(3000, 1100), 4096) == 1000
    assert bin_bound(np.full(4, 1024), 4096) == 1
    assert bin_bound(np.array([], np.int64), 4096) == 0


def test_bound_is_never_above_a_packing():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([7, 10, 64, 100])
        lengths = np.array([rng.randint(1, rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(1, 40))])
        assert bin_bound(lengths, capacity) <= len(best_fit_decreasing(lengths, capacity)[2])
        # Pieces of full sequences: the optimum is known.
        cut = [np.diff(np.unique([0, capacity, *rng.choices(range(capacity), k=3)])) for _ in range(9)]
        assert bin_bound(np.concatenate(cut), capacity) == 9


def test_partitions_stay_small_where_nothing_is_certified(spark):
    """Best fit decreasing takes 30s by three and 22s by four, the optimum one 30 and three 22s."""
    options = PackingOptions("", capacity=100, partition_pieces=100)
    rows = packed(spark, [30, 22, 22, 22] * 300, options)
    groups = Counter(r.sequence_id >> 24 for r in rows)
    assert max(groups.values()) < 200
    assert all(r.bound < r.bins for r in rows)  # the gap is told


def test_pieces_that_go_by_two(spark):
    rows = packed(spark, [1500] * 1000, PackingOptions("", partition_pieces=100))
    assert len({r.sequence_id for r in rows}) == 500
