"""Byte-level BPE against the tokenizer library and against merging pair by pair."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from groundsieve.llm import byte_bpe
from groundsieve.llm.byte_bpe import ByteBpe, ByteBpeOptions, PairTable, Vocabulary, merge_long, merge_rows

OPTIONS = ByteBpeOptions(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
CODEC = ByteBpe(OPTIONS)
WANTED = tiktoken.Encoding("wanted", pat_str=OPTIONS.pattern, mergeable_ranks=CODEC.vocabulary.ranks, special_tokens={})


def check(texts, codec=CODEC):
    ids, offsets = codec.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [WANTED.encode_ordinary(t or "") for t in texts]
    data, bounds = codec.decode(ids, offsets)
    assert [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] == [(t or "").encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(st.one_of(
    st.sampled_from(" \n\t\r'sStTlLabcxyzé \u0085 \x1c東9٣²ǅ"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_texts(texts):
    check(texts)


def test_every_character_of_the_first_planes():
    check(["".join(f"a{chr(c)} b{chr(c)}{chr(c)}" for c in range(low, low + 256) if not 0xD800 <= c < 0xE000)
           for low in range(0, 0x20000, 256)])


@pytest.mark.parametrize("seed", range(6))
def test_long_matches(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "a", "etaoin", "aeéç東", " "])
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 1000, 5000)]
    check([" ".join(texts), *texts, None, ""])
    check(texts, ByteBpe(ByteBpeOptions(OPTIONS.ranks, OPTIONS.pattern, wide=3)))


def by_pair(ids, pairs):
    ids = list(ids)
    while len(ids) > 1:
        ranks = pairs.merged(np.array(ids[:-1]), np.array(ids[1:]))
        at = int(ranks.argmin())
        if ranks[at] == byte_bpe._NONE:
            break
        ids[at: at + 2] = [int(ranks[at])]
    return ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), unique=True, max_size=30),
       st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=14), min_size=1, max_size=5))
def test_any_order_of_ranks(pairs, rows):
    """Merge tables in which a merge may make a pair of lower rank than its own."""
    merged = np.random.default_rng(len(pairs)).permutation(len(pairs)) + 4
    left, right = np.array(pairs, np.int32).reshape(-1, 2).T
    table = PairTable(left, right, merged.astype(np.int32))
    matrix = np.full((len(rows), max(map(len, rows))), -1, np.int32)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    out, sizes = merge_rows(matrix, table)
    for i, row in enumerate(rows):
        want = by_pair(row, table)
        assert out[i, : sizes[i]].tolist() == want and (out[i, sizes[i]:] == -1).all()


@settings(max_examples=100, deadline=None)
@given(st.text("abcé ", min_size=1, max_size=300))
def test_long_rows_merge_like_short_ones(text):
    ids = CODEC.vocabulary.single[np.frombuffer(text.encode(), np.uint8)]
    assert merge_long(ids, CODEC.vocabulary.pairs).tolist() == by_pair(ids, CODEC.vocabulary.pairs)


def test_a_full_memory_is_cleared():
    codec = ByteBpe(ByteBpeOptions(OPTIONS.ranks, OPTIONS.pattern, remembered=3))
    for text in ("one two three four", "four five", "one two " + "ab" * 400, "one " + "ab" * 400):
        check([text], codec)
    assert len(codec.slot) <= 4


def test_a_vocabulary_without_all_bytes(tmp_path):
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)) + b"\n")
    with pytest.raises(ValueError, match="255"):
        Vocabulary(str(tmp_path / "ranks"))


def test_documents(messy, messy_rows):
    got = byte_bpe.byte_bpe_digests(messy, OPTIONS).collect()
    want = []
    for key, text in messy_rows:
        ids = WANTED.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    encoded = byte_bpe.byte_bpe_encoded(messy, OPTIONS)
    decoded = byte_bpe.byte_bpe_decoded(encoded, OPTIONS).collect()
    assert sorted(((r.doc_id, bytes(r.content).decode()) for r in decoded), key=repr) == sorted(
        ((i, t or "") for i, t in messy_rows), key=repr)


def test_nothing(nothing):
    assert byte_bpe.byte_bpe_digests(nothing, OPTIONS).count() == 0
    assert byte_bpe.byte_bpe_decoded(byte_bpe.byte_bpe_encoded(nothing, OPTIONS), OPTIONS).count() == 0
