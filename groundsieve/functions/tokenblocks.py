"""Arrow block kernels over texts and arrays of tokens and codes: all rows of a batch are cut and
counted at once, and a token that a batch repeats is looked at once. Imports neither Spark nor this
package, so executors need only numpy and pyarrow.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ASCII_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all rows, and for each the row it belongs to."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _nested(lists: pa.Array, owner: np.ndarray, items: pa.Array) -> pa.Array:
    """Items back in rows; ``owner`` ascends, and a row that was null stays null."""
    offsets = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=mask)


def counted(lists: pa.Array) -> pa.Array:
    """Distinct tokens of every row in the order of their bytes with their counts, as (term, tf)."""
    tokens, owner = _flat(lists)
    coded = tokens.dictionary_encode()
    words = coded.dictionary
    # Strings are compared as bytes here as in Spark.
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return _tallied(lists, owner, place[coded.indices.to_numpy(zero_copy_only=False)], words.take(pa.array(order)))


def _tallied(rows: pa.Array, owner: np.ndarray, ranks: np.ndarray, words: pa.Array) -> pa.Array:
    """(term, tf) of every row from the places of its tokens among the ordered words."""
    cells, n = np.unique(owner.astype(np.int64) * max(len(words), 1) + ranks, return_counts=True)
    at, ranks = np.divmod(cells, max(len(words), 1))
    return _nested(rows, at, pa.StructArray.from_arrays(
        [words.take(pa.array(ranks)), pa.array(n.astype(np.int32))], ["term", "tf"]))


def _codes(words: pa.Array, dims: int) -> np.ndarray:
    """The code of every word, as ``vectors.hash_codes`` defines it; a word that comes again is hashed once."""
    coded = words.dictionary_encode()
    held = Texts(coded.dictionary)
    data, ends = held.bytes.tobytes(), held.offsets.tolist()
    digests = np.frombuffer(b"".join(sha256(data[a:b]).digest() for a, b in zip(ends, ends[1:])), np.uint8).reshape(-1, 32)
    numbers = np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) % dims + 1
    codes = np.where(digests[:, 4] & 1, -numbers, numbers).astype(np.int32)
    return codes[coded.indices.to_numpy(zero_copy_only=False)]


def hashed(lists: pa.Array, dims: int) -> pa.Array:
    """For every token a signed dimension number from 1, as ``vectors.hash_codes`` defines it."""
    tokens, owner = _flat(lists)
    return _nested(lists, owner, pa.array(_codes(tokens, dims)))


class Texts:
    """The texts of a batch as bytes, and where each begins."""

    def __init__(self, texts: pa.Array):
        self.rows = texts
        whole = pc.fill_null(texts, "").cast(pa.string())
        _, starts, data = whole.buffers()
        ends = np.frombuffer(starts, np.int32)[whole.offset: whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int32)
        self.bytes = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        self.offsets = ends - ends[0]

    def words(self, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The runs of bytes that are ``inside`` words, and for each the row it stands in."""
        if not inside.any():
            return pa.array([], pa.string()), np.empty(0, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True  # a word ends with its row
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        starts = np.flatnonzero(after & (edge | ~before))
        ends = np.flatnonzero(before & (edge | ~after))
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(self.bytes[inside])))
        return words, np.searchsorted(self.offsets, starts, side="right") - 1

    def spaces(self, characters: str) -> np.ndarray:
        """Which bytes belong to one of the characters (of at most three bytes in UTF-8)."""
        data, found = self.bytes, np.zeros(len(self.bytes), bool)
        for size in (1, 2, 3):
            codes = [int.from_bytes(c.encode()) for c in characters if len(c.encode()) == size]
            if not codes or len(data) < size:
                continue
            leads = np.isin(np.arange(256), [c >> 8 * (size - 1) for c in codes])
            at = np.flatnonzero(leads[data[:len(data) - size + 1]])
            code = sum(data[at + i].astype(np.int64) << 8 * (size - 1 - i) for i in range(size))
            at = at[np.isin(code, codes)]
            for i in range(size):
                found[at + i] = True
        return found


def _stemmed(words: pa.Array) -> pa.Array:
    """``text.light_stem`` of words of ASCII letters and digits, by their last bytes."""
    held = Texts(words)
    data, ends, size = held.bytes.copy(), held.offsets[1:], np.diff(held.offsets)

    def last(n: int, letters: bytes) -> np.ndarray:
        there = size >= n
        return there & np.isin(data[np.where(there, ends - n, 0)], np.frombuffer(letters, np.uint8))

    es = last(1, b"s") & last(2, b"e") & (size >= 5)
    ies = es & last(3, b"i")
    es_cut = es & (last(3, b"h") & last(4, b"cs") | last(3, b"s") & last(4, b"s") | last(3, b"xz"))
    s_cut = last(1, b"s") & (size >= 5) & ~last(2, b"s") & ~(es & last(3, b"s")) & ~ies & ~es_cut
    ing = last(1, b"g") & last(2, b"n") & last(3, b"i") & (size >= 6)
    ed = last(1, b"d") & last(2, b"e") & (size >= 5)
    cut = 1 * s_cut + 2 * (ies | es_cut | ed) + 3 * ing
    data[ends[ies] - 3] = ord("y")
    kept = np.ones(len(data), bool)
    for n in (1, 2, 3):
        kept[ends[cut >= n] - n] = False
    places = np.concatenate([[0], np.cumsum(size - cut)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(places), pa.py_buffer(data[kept]))


class Indexer:
    """Texts in lower case to the length, the counted terms and the hashed tokens of each.

    Terms are those of ``text.lexical_tokens``: words that are ``dropped`` go before they are stemmed,
    those of ``stop`` after. Codes are those of ``vectors.hash_codes``, of the words between
    ``spaces``, left out without ``dims``.
    """

    def __init__(self, stop: list[str], dropped: list[str], spaces: str, dims: int | None):
        self.stop, self.dropped = pa.array(["", *stop], pa.string()), pa.array(dropped, pa.string())
        self.space, self.dims = spaces, dims

    def __call__(self, texts: pa.Array) -> pa.Array:
        held = Texts(texts)
        mask = texts.is_null() if texts.null_count else None
        owner, ranks, terms = self._terms(*held.words(_ASCII_WORD[held.bytes]))
        length = pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32),
                          mask=None if mask is None else mask.to_numpy(zero_copy_only=False))
        out = {"length": length, "entries": _tallied(texts, owner, ranks, terms)}
        if self.dims is not None:
            words, owner = held.words(~held.spaces(self.space))
            out["vector"] = _nested(texts, owner, pa.array(_codes(words, self.dims)))
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    def _terms(self, words: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The rows of the tokens that count, their places among the ordered terms, and these."""
        coded = words.dictionary_encode()
        dropped = pc.is_in(coded.dictionary, value_set=self.dropped).to_numpy(zero_copy_only=False)
        stems = _stemmed(coded.dictionary).dictionary_encode()
        order = pc.sort_indices(stems.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place[pc.is_in(stems.dictionary, value_set=self.stop).to_numpy(zero_copy_only=False)] = -1
        of_word = np.where(dropped, -1, place[stems.indices.to_numpy(zero_copy_only=False)])
        ranks = of_word[coded.indices.to_numpy(zero_copy_only=False)]
        return owner[ranks >= 0], ranks[ranks >= 0], stems.dictionary.take(pa.array(order))


def summed(lists: pa.Array) -> pa.Array:
    """Codes of every row as (dim from 0, weight) of the unit vector, zeros left out."""
    codes, owner = _flat(lists)
    codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(np.abs(codes).max(initial=0)) + 1
    cells, at = np.unique(owner.astype(np.int64) * width + np.abs(codes) - 1, return_inverse=True)
    totals = np.bincount(at, weights=np.sign(codes), minlength=len(cells))
    cells, totals = cells[totals != 0], totals[totals != 0]
    rows, dims = np.divmod(cells, width)
    norms = np.sqrt(np.bincount(rows, weights=totals * totals, minlength=len(lists)))
    return _nested(lists, rows, pa.StructArray.from_arrays(
        [pa.array(dims.astype(np.int32)), pa.array(totals / norms[rows])], ["dim", "weight"]))
