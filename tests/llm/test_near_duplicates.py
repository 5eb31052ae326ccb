"""The join against all pairs of n-gram sets in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from groundsieve.llm import near_duplicates
from groundsieve.llm.graph import components
from groundsieve.llm.hashing import PUNCTUATION
from groundsieve.llm.near_duplicates import JaccardOptions
from llm_tools import documents, prose


def words(text):
    return tuple(w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if w)


def grams(w):
    return frozenset(w[k: k + 5] for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])


def grouped(rows):
    """The ids of each distinct text, its links, and a number of its class."""
    units = defaultdict(list)
    for i, t in rows:
        units[words(t)].append(i)
    texts = list(units)
    sets, links, group = [grams(w) for w in texts], [0] * len(texts), list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                group[root(a)] = root(b)
    return list(units.values()), links, [root(k) for k in range(len(texts))]


def brute_force(rows):
    """(id, class id, links, copies) of every row."""
    units, links, classes = grouped(rows)
    first = {}
    for ids, c in zip(units, classes):
        known = [i for i in [*ids, first.get(c)] if i is not None]
        first[c] = min(known, default=None)
    return sorted((((i is None, i or 0), first[c], n, len(ids) - 1)
                  for ids, c, n in zip(units, classes, links) for i in ids), key=repr)


def near_copy(text, rng, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10 ** 6))
    return " ".join(w)


def result(frame, options=JaccardOptions()):
    return sorted((((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links, r.n_copies)
                  for r in near_duplicates.near_duplicate_classes(frame, options).collect()), key=repr)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    big, rows = prose(rng, 8, 20), []
    for i in range(70):  # a large group, of which many but not all are linked
        rows.append((i, near_copy(big, rng, rng.choice([0, 1, 2, 3, 4]))))
    for i in range(70, 130):
        own = prose(rng, 4, 20)
        rows += [(i, own), (i + 1000, near_copy(own, rng, rng.choice([0, 1, 2])))]
    return rows


@pytest.mark.parametrize("block", [1000, 16])
def test_against_all_pairs(spark, copies, block):
    assert result(documents(spark, copies), JaccardOptions(block=block, bin_units=20)) == brute_force(copies)


def test_messy(messy, messy_rows):
    assert result(messy) == brute_force(messy_rows)


def test_nothing(nothing):
    assert near_duplicates.near_duplicate_classes(nothing).count() == 0
    assert near_duplicates.keep_first(nothing).count() == 0


def test_first_of_each_class_stays(spark, copies):
    frame = documents(spark, copies)
    kept = near_duplicates.keep_first(frame)
    assert kept.columns == frame.columns
    want = {(i, c) for (_, i), c, _, _ in brute_force(copies)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want if i == c)


def test_first_stays_of_repeated_and_missing_ids(messy, messy_rows):
    kept = near_duplicates.keep_first(messy).collect()
    # Rows 1, 1, 7 and one without id hold one story; no class has two rows left, none has none.
    left = [words(r.text) for r in kept]
    assert len(left) == len(set(left))
    assert sum(r.doc_id == 1 for r in kept) == 1 and sum(r.doc_id == 2 for r in kept) == 2
    assert len(kept) == len(set(grouped(messy_rows)[2]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(7, 9), (9, 8), (5, 5), (9, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, 7: 7, 8: 7, 9: 7}


def test_band_shape():
    bands, rows = near_duplicates.band_shape(JaccardOptions())
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= 128
    with pytest.raises(ValueError):
        near_duplicates.band_shape(JaccardOptions(threshold=0.05))


def test_a_unit_whose_set_comes_several_times_counts_once(spark):
    verify = near_duplicates.verify

    grams = np.arange(20, dtype=np.uint64)
    sets = [(u, 0, 2, grams[: 20 - u % 2].tobytes()) for u in range(6)] + [(9, 9, 1, grams[:5].tobytes())]
    frame = spark.createDataFrame(
        [(u, l, b, bytearray(g)) for u, l, b, g in sets + sets[2:5] + sets[-1:]], "unit long, label long, blocks int, grams binary")
    rows = verify(frame, len(sets), JaccardOptions(block=3)).collect()
    links = {u: sum(r["links"] for r in rows if r["unit"] == u) for u in (*range(6), 9)}
    assert links == dict.fromkeys(range(6), 5) | {9: 0}
