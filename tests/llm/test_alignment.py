"""Alignment of two tokenizers against every pair of tokens, taken one by one."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from groundsieve.llm import alignment
from groundsieve.llm.alignment import AlignmentOptions, Planes, TokenizerPair, merge_or, pack_bitmaps, unpack_bitmaps

OPTIONS = AlignmentOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
PAIR = TokenizerPair(OPTIONS)
A, B = Tokenizer.from_file(OPTIONS.first), SentencePieceProcessor(model_file=OPTIONS.second)
A.encode_special_tokens = True
ALPHABET = alignment.byte_alphabet()


def spans(sizes):
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends], ends))


def by_hand(text):
    """(a ids, b ids, groups, links) of a text."""
    if not text:
        return [], [], [], []
    given = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False), B.encode(text)
    raw_a = [bytes(ALPHABET[c] for c in t) for t in a.tokens]
    raw_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in zip(b, B.id_to_piece(b))]
    if b"".join(raw_a) != given or b"".join(raw_b) != given:
        return [], [], [], []
    at_a, at_b = spans([len(r) for r in raw_a]), spans([len(r) for r in raw_b])
    common = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups = [([], []) for _ in common]
    for side, (ids, at) in enumerate(((a.ids, at_a), (b, at_b))):
        for i, (_, end) in zip(ids, at):
            groups[bisect_left(common, end)][side].append(i)
    links, first = [], 0
    for i, (start, end) in zip(a.ids, at_a):
        while at_b[first][1] <= start:
            first += 1
        for j, (low, high) in zip(b[first:first + 64], at_b[first:first + 64]):
            if low < end and start < high:
                links.append((i, j))
    return a.ids, b, groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def rows_by_hand(docs):
    found = [(key, *by_hand(text)) for key, text in docs]
    holding = Counter(pair for *_, links in found for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in holding.items():
        highest[a] = max(highest[a], n)
    return holding, [
        (key, len(a), len(b), len(groups), len(links), sum(holding[x] == highest[x[0]] for x in links),
         sum(holding[x] for x in links), hashlib.sha256(written(groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, links in found]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.one_of(
    st.sampled_from(" \n\t'aetoinsé▁<|>½ﬁ東"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_texts(texts):
    got = PAIR.encode(pa.array(texts, pa.string()))
    for text, groups, a, b, n_groups, n_links in zip(texts, got.groups(), got.n_a, got.n_b, got.n_groups, got.n_links):
        ids_a, ids_b, want, links = by_hand(text)
        assert [(g["a"], g["b"]) for g in groups] == want
        assert (a, b, n_groups, n_links) == (len(ids_a), len(ids_b), len(want), len(links))


def test_a_full_memory_is_cleared(monkeypatch):
    monkeypatch.setattr("groundsieve.llm.alignment._WORDS", 4)
    pair = TokenizerPair(OPTIONS)
    for texts in (["one two three", "four  five"], ["one six", None, "seven\neight nine ten", "one"], ["two ▁ x", "one"]):
        got = pair.encode(pa.array(texts)).groups()
        assert [[(g["a"], g["b"]) for g in x] for x in got] == [by_hand(t)[2] for t in texts]


@pytest.mark.parametrize("folder", ["check_l", "check_h"])
def test_words_one_by_one_give_the_ids_of_whole_texts(folder):
    texts = next(ds.dataset(f"/root/testdata/{folder}/documents.parquet").to_batches(
        columns=["text"], batch_size=1500)).column("text").slice(0, 1500)
    for (ids, n), (want, lengths) in zip(PAIR._encoded(texts), PAIR._whole(texts.to_pylist())):
        assert n.tolist() == lengths.tolist() and np.array_equal(ids, want)


def test_tokens_that_are_not_given_back():
    got = PAIR.encode(pa.array(["a ▁ b", "<|endoftext|> <s>", "plain words"]))
    assert got.n_a.tolist()[0] == 0 and got.n_b.tolist()[0] == 0 and min(got.n_a[1:]) > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 5, 4095, 4096, 4097, 30_000, 65_536]), max_size=6), st.integers(0, 100))
def test_bitmaps(sizes, seed):
    rng = np.random.default_rng(seed)
    sets = [np.sort(rng.choice(65_536, n, replace=False)) for n in sizes]
    group = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    packed, bounds = pack_bitmaps(group, np.concatenate([np.empty(0, np.int64), *sets]), len(sizes))
    assert (np.diff(bounds) <= 4096).all()
    back, numbers = unpack_bitmaps(packed, bounds)
    assert [numbers[back == g].tolist() for g in range(len(sizes))] == [x.tolist() for x in sets]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 40)), st.integers(1, 5000), min_size=1))
def test_planes(links):
    keys = sorted(links)
    place = np.array([code << 16 | doc for code, doc in keys])
    planes = Planes.of(place, np.array([links[k] for k in keys]))
    documents, total = planes.counts()
    assert documents.tolist() == [sum(c == code for c, _ in keys) for code in planes.codes]
    assert total.tolist() == [sum(n for (c, _), n in links.items() if c == code) for code in planes.codes]
    pair, doc, weight = planes.unpacked()
    back = Counter()
    for p, d, w in zip(pair.tolist(), doc.tolist(), weight.tolist()):
        back[int(planes.codes[p]), d] += w
    assert back == links


def test_merged_slices():
    one, two = (np.array([1, 5, 9]), np.array([1, 2, 3])), (np.array([2, 5]), np.array([4, 5]))
    place, links = merge_or([one, two])
    assert place.tolist() == [1, 2, 5, 9] and links.tolist() == [1, 4, 7, 3]


@pytest.mark.parametrize("options", [
    OPTIONS, AlignmentOptions(OPTIONS.first, OPTIONS.second, block_documents=3),
    AlignmentOptions(OPTIONS.first, OPTIONS.second, block_postings=50)])
def test_documents(messy, messy_rows, options):
    got = alignment.alignment_table(messy, options).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows_by_hand(messy_rows)[1], key=repr)


def test_pair_counts(spark):
    rng = random.Random(2)
    words = ["stone", "stones", "éléments", "un", "uncommonly", "the", "東京", "thatandthat", "x1y2"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    options = AlignmentOptions(OPTIONS.first, OPTIONS.second, block_documents=40)
    postings = alignment.build_postings(table, options)
    holding, want = rows_by_hand(docs)
    links = Counter(x for _, text in docs for x in by_hand(text)[3])
    got = alignment.pair_counts(postings, options).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in got} == {x: (holding[x], links[x]) for x in holding}
    assert {(r.a, r.b) for r in got if r.best} == {
        x for x in holding if holding[x] == max(n for y, n in holding.items() if y[0] == x[0])}
    rows = alignment.alignment_table(table, options).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    groups = alignment.aligned_groups(table, options).collect()
    assert {r.doc_id: [(g.a, g.b) for g in r.groups] for r in groups} == {i: by_hand(t)[2] for i, t in docs}


def test_nothing(nothing):
    assert alignment.alignment_table(nothing, OPTIONS).count() == 0
    assert alignment.aligned_groups(nothing, OPTIONS).count() == 0


def test_merging_a_block_holds_no_second_copy_of_it():
    import tracemalloc

    from groundsieve.llm.alignment import _pair_rows, by_part

    rng = np.random.default_rng(5)
    slices = []
    for first in range(0, 4000, 1000):
        place = np.unique(rng.integers(0, 1 << 31, 200_000) << 16 | rng.integers(first, first + 1000, 200_000))
        slices.append((place, rng.integers(1, 5, len(place))))
    held = [by_part(*x) for x in slices]
    size = sum(a.nbytes + b.nbytes for a, b in slices)
    tracemalloc.start()
    found = 0
    for row in _pair_rows(3, held, pa.int64()):
        found += sum(row.column("n_links_of").to_pylist()[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(int(links.sum()) for _, links in slices)
    assert peak < size / 2
