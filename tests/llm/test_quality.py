"""Measures against plain Python, and the estimated rules."""

from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from groundsieve.llm import quality
from llm_tools import documents, prose, sentence


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)], set(), 0
    for l in lines:
        dup += l in seen
        seen.add(l)
    windows = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i: i + 8])] > 1 for k in range(i, i + 8)}
    n, repeats = len(words), len(inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeats,
            n < 20 or 100 * repeats > 30 * n)


def table_of(docs):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                   r.n_repeat_words, r.base_failed) for r in quality.quality_table(docs).collect())


def test_measures(messy, messy_rows):
    assert table_of(messy) == sorted(((i is None, i or 0), *plain(t)) for i, t in messy_rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "#x", "\n", "\x0b", " ", "\t", "  "]), max_size=60).map(" ".join), max_size=12))
def test_measures_of_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert table_of(documents(spark, rows)) == sorted(((False, i), *plain(t)) for i, t in rows)


def test_nothing(nothing):
    assert quality.quality_table(nothing).count() == 0
    assert quality.keep_good(nothing).count() == 0


def junk(rng, k):
    words = sentence(rng, 60).split()
    return [" ".join(w.upper() + "!!" for w in words), " ".join(w + "%%%" for w in words), " | ".join(words),
            " ".join(w for w in words[:8] for _ in range(12))][k % 4]


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng, i)) if i % 7 == 0 else (i, prose(rng, 1 + i % 9, 25)) for i in range(280)]
    docs = documents(spark, rows)
    kept = {r.doc_id for r in quality.quality_table(docs).where("kept").collect()}
    assert kept == {i for i in range(280) if i % 7}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(good.collect()) == sorted(docs.where("doc_id % 7 <> 0").collect())


def test_estimated_votes():
    """Each rule finds one kind of bad texts; the third one finds nothing."""
    counts, rng = Counter(), random.Random(1)
    for _ in range(4000):
        kind = rng.choice([None] * 6 + [0, 1])
        votes = [-1 if kind == r else 1 for r in range(2)] + [rng.choice([0, 1])]
        counts[sum((v + 1) * 3 ** (2 - k) for k, v in enumerate(votes))] += 1
    posterior = quality.fit_patterns(dict(counts), 3)
    assert len(posterior) == 6
    for pattern, p in posterior.items():
        assert p < 0.1 if -1 in quality.votes_of(pattern, 3) else p > 0.9
    assert quality.fit_patterns({}, 3) == {}


def simulated(errs, texts=40_000, rules=7):
    """Counts of patterns where the first rule errs on a share of all texts and the others agree on bad ones."""
    counts, rng = Counter(), random.Random(2)
    for _ in range(texts):
        bad = rng.random() < 0.1
        votes = [-1 if rng.random() < errs else 1] + [-1 if bad and rng.random() < 0.7 else 1 for _ in range(rules - 1)]
        counts[encoded(votes)] += 1
    return dict(counts)


def encoded(votes):
    return sum((v + 1) * 3 ** (len(votes) - 1 - k) for k, v in enumerate(votes))


def test_a_rule_that_errs_alone_is_outvoted():
    lone = encoded([-1] + [1] * 6)
    for errs in (0.002, 0.02):
        posterior = quality.fit_patterns(simulated(errs), 7)
        assert posterior[lone] > 0.9
        for pattern, p in posterior.items():
            if sum(v == -1 for v in quality.votes_of(pattern, 7)[1:]) > 1:
                assert p < 0.1
    # Nothing else to go by: six rules against one.
    assert quality.fit_patterns({encoded([1] * 7): 998_000, lone: 2000}, 7)[lone] > 0.9


def test_a_rule_that_avoids_the_others_findings_sees_a_kind_of_its_own():
    lone, pair = encoded([-1] + [1] * 6), encoded([1, 1, 1, -1, -1, 1, 1])
    posterior = quality.fit_patterns({encoded([1] * 7): 8600, lone: 700, pair: 700}, 7)
    assert posterior[lone] < 0.5 and posterior[pair] < 0.1


def test_only_proportions_of_patterns_count():
    for counts in (simulated(0.002, 10_000), {encoded([1] * 7): 9980, encoded([-1] + [1] * 6): 20}):
        few = quality.fit_patterns(counts, 7)
        many = quality.fit_patterns({p: 100 * n for p, n in counts.items()}, 7)
        assert all(abs(few[p] - many[p]) < 1e-6 for p in counts)
