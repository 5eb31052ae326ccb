"""Piecewise encoding, token files and packing against the tokenizer itself."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from groundsieve.llm import packing, token_files
from groundsieve.llm.encoding import PieceEncoder, with_last_id
from groundsieve.llm.packing import PackingOptions, best_fit_decreasing, bin_bound
from groundsieve.llm.token_files import TokenFile, TokenFileOptions

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, WHOLE = PieceEncoder(PATH), Tokenizer.from_file(PATH)


def encoded(text: str) -> list[int]:
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(
    st.sampled_from(" \n\t.'aBé1,sLH̱-<|>\x01\x0b\x85"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encoded(t) for t in texts]


def test_a_full_cache_is_cleared(monkeypatch):
    monkeypatch.setattr("groundsieve.llm.encoding.CACHE_PIECES", 3)
    encoder = PieceEncoder(PATH)
    for text in ("one two", "three four", "one five"):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoded(text)


def test_last_ids():
    ids, offsets = with_last_id(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9] and offsets.tolist() == [0, 3, 4, 6]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(messy, messy_rows):
    options = TokenFileOptions(PATH, shard_bytes=300)
    files = token_files.write_token_files(messy, options)
    got = token_files.read_token_files(files).collect()
    assert files.manifest.count() > 3  # more shards than partitions
    want = sorted(((i is not None, i or 0), crc(encoded(t) + [2])) for i, t in messy_rows)
    got = sorted(got, key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got) == want
    # Ids follow each other in ascending order without gaps, missing ones first.
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)


def test_one_document_is_read_by_itself(messy, messy_rows):
    files = token_files.write_token_files(messy, TokenFileOptions(PATH))
    dictionary = token_files.read_dictionary(files.dictionary_path)
    found = [ids.tolist() for r in files.manifest.collect() for ids in TokenFile(r.path, dictionary).find(2)]
    assert sorted(found) == sorted(encoded(t) + [2] for i, t in messy_rows if i == 2)
    with pytest.raises(ValueError, match="another dictionary"):
        TokenFile(files.manifest.first().path, dictionary + b"x")


def test_token_files_of_nothing(nothing):
    assert token_files.token_digests(nothing, TokenFileOptions(PATH)).count() == 0


def check_packing(rows, capacity):
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and 0 < length <= capacity
            at += length
        assert at <= capacity
    return len(by_sequence), by_document


@pytest.mark.parametrize("capacity, pieces", [(4096, 50_000), (64, 12)])
def test_packing(messy, messy_rows, capacity, pieces):
    options = PackingOptions(PATH, capacity=capacity, partition_pieces=pieces, merge=3)
    rows = packing.pack_documents(messy, options).collect()
    used, by_document = check_packing(rows, capacity)
    want = defaultdict(list)
    for i, t in messy_rows:
        ids = encoded(t) + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a: a + capacity]
            want[i].append((k, a, len(part), crc(part)))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for i, rs in by_document.items()} == {
        i: sorted(v) for i, v in want.items()}
    bound = bin_bound(np.array([r.length for r in rows]), capacity)
    assert bound <= used <= bound + 1


def test_packed_ids(messy, messy_rows):
    options = PackingOptions(PATH, capacity=128)
    pieces = packing.document_pieces(messy, options, with_ids=True)
    filled = packing.sequences(packing.pack(pieces, options)).collect()
    assert sum(len(r.ids) for r in filled) == sum(len(encoded(t)) + 1 for _, t in messy_rows)
    assert max(len(r.ids) for r in filled) <= 128


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing, PackingOptions(PATH)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_best_fit_against_a_plain_form_and_the_bound(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offsets, room = best_fit_decreasing(lengths, 30)
    left: list[int] = []
    for size in sorted(sizes, reverse=True):
        fitting = [k for k in range(len(left)) if left[k] >= size]
        if fitting:
            left[min(fitting, key=lambda k: left[k])] -= size
        else:
            left.append(30 - size)
    assert sorted(left) == sorted(room)
    # Each bound of a dual-feasible function, taken one by one.
    bounds = [0]
    for k in range(16):
        lifted = sum(30 if s > 30 - k else s if s >= k else 0 for s in sizes)
        bounds.append(-(-lifted // 30))
    for k in range(1, 31):  # rounded down to parts of k, or s / 30 itself where that is a whole number of them
        total = sum(Fraction(s, 30) if (k + 1) * s % 30 == 0 else Fraction((k + 1) * s // 30, k) for s in sizes)
        bounds.append(math.ceil(total))
    assert bin_bound(lengths, 30) == max(bounds) <= len(room)


def test_a_worker_keeps_a_bounded_number_of_pieces():
    from groundsieve.llm.queries import TOKENIZER

    encoder, most = PieceEncoder(TOKENIZER), 0
    for first in range(0, 600_000, 60_000):
        encoder.encode(pa.array([" ".join(f"{i:x}" for i in range(first, first + 60_000))]))
        most = max(most, len(encoder.slot))
    assert most <= 400_000
