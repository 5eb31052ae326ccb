"""Byte-level BPE by merge ranks: whole texts to ids and ids back to bytes, in numpy.

1. A pattern cuts a text into matches, and every match is merged by itself. A
   task merges each distinct match once and looks it up afterwards.
2. New matches are sorted into buckets by length, each a padded matrix with one
   match in a row. A round merges the leftmost pair of lowest rank in every row,
   closes the gap, and drops rows that have no pair left; the matrix loses a
   column with each round. The rank of a pair comes from an open-addressed hash table.
3. A match longer than ``wide`` bytes is a row of its own. Its rounds merge all
   places of the lowest pair from left to right, up to the first place that makes
   a pair of lower rank, which is the same order of merges.
4. Decoding gathers the bytes of all ids of a batch at once.

Texts stay in the task that reads them; nothing is shuffled.

Defined results: a null text is empty, an empty text has no ids; a match that is
a vocabulary entry is that entry; the strings of special tokens are plain text;
repeated rows and null keys are kept; an empty table gives no rows; other columns
are ignored. A vocabulary without one of the 256 single bytes is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from groundsieve.llm.common import sliced, texts_of, worker_state

_NONE = np.int32(2**31 - 1)
_CELLS = 2_000_000  # of a matrix that is merged at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ByteBpeOptions:
    ranks: str                      # path of a file with a base64 token and its rank in each line
    pattern: str                    # what is merged by itself
    wide: int = 256                 # bytes; longer matches are merged one by one and not remembered
    remembered: int = 1_000_000     # distinct matches that a worker keeps


class PairTable:
    """Open-addressed hash table from two neighbouring ids to the id that they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(merged), 1)))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        key = self._key(left, right)
        at, waiting, self.probes = self._home(key), np.arange(len(key)), 0
        while len(waiting):
            free = waiting[self.keys[at[waiting]] < 0]
            self.keys[at[free]] = key[free]  # of several for one place the last stays
            placed = self.keys[at[waiting]] == key[waiting]
            held = waiting[placed]
            self.values[at[held]] = merged[held]
            waiting = waiting[~placed]
            at[waiting] = (at[waiting] + 1) & (len(self.keys) - 1)
            self.probes += 1

    @staticmethod
    def _key(left, right) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair the id it merges into, or the largest number."""
        key = self._key(left, right)
        at = self._home(key)
        out = np.where(self.keys[at] == key, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Vocabulary:
    """The ids of a rank file: their bytes, and which pairs of them merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no id for the bytes {missing}")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:cut]], self.ranks[t[cut:]], rank) for t, rank in self.ranks.items()
                 for cut in range(1, len(t)) if t[:cut] in self.ranks and t[cut:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        numbers = [str(i) for i in range(size)]
        # Decimal ids, followed by a comma or not.
        self.decimal = pa.array([text for n in numbers for text in (n, n + ",")])

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and where each id ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at], ends


def merge_rows(matrix: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges the rows of a matrix of ids, padded with -1 on the right. Returns
    the matrix of what is left of each row, and how many ids that is."""
    out, sizes = np.full_like(matrix, -1), (matrix >= 0).sum(axis=1)
    row, held = np.arange(len(matrix)), matrix.copy()
    rank = np.full((len(matrix), max(matrix.shape[1] - 1, 1)), _NONE, np.int32)
    if matrix.shape[1] > 1:
        both = held[:, 1:] >= 0
        rank[both] = pairs.merged(held[:, :-1][both], held[:, 1:][both])
    while len(row):
        place = rank.argmin(axis=1)  # the first of equal ones
        lowest = rank[np.arange(len(row)), place]
        done = lowest == _NONE
        if done.any():
            out[row[done], : held.shape[1]] = held[done]
            row, held, rank, place, lowest = (x[~done] for x in (row, held, rank, place, lowest))
            if not len(row):
                break
        each = np.arange(len(row))
        held[each, place] = lowest
        # Every row gives up the id right of its place, and the matrix a column.
        keep = np.arange(held.shape[1] - 1)
        held = np.take_along_axis(held, keep + (keep > place[:, None]), axis=1)
        keep = np.arange(max(rank.shape[1] - 1, 1))
        shifted = np.minimum(keep + (keep > place[:, None]), rank.shape[1] - 1)
        rank = np.take_along_axis(rank, shifted, axis=1)
        sizes[row] -= 1
        if held.shape[1] == 1:
            rank[:] = _NONE
            continue
        for left in (place - 1, place):
            inside = (left >= 0) & (left + 1 < held.shape[1])
            r, c = each[inside], left[inside]
            right = held[r, c + 1]
            known = right >= 0
            fresh = np.full(len(r), _NONE, np.int32)
            fresh[known] = pairs.merged(held[r[known], c[known]], right[known])
            rank[r, c] = fresh
        last = place >= held.shape[1] - 1  # merged with the last column: no pair begins there
        rank[each[last], rank.shape[1] - 1] = np.where(
            place[last] > rank.shape[1] - 1, rank[each[last], rank.shape[1] - 1], _NONE)
    return out, sizes


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The same for one long row: a round merges all places of its lowest pair."""
    rank = pairs.merged(ids[:-1], ids[1:])
    while len(rank) and (lowest := rank.min()) != _NONE:
        at = np.flatnonzero(rank == lowest)
        run = np.concatenate([[True], np.diff(at) != 1])
        first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        at = at[(at - first) % 2 == 0]  # of overlapping places every other one
        merged, new, middle = _merge_at(ids, at, lowest)
        left = np.full(len(at), _NONE, np.int32)
        left[middle > 0] = pairs.merged(new[middle[middle > 0] - 1], merged[middle > 0])
        right = np.full(len(at), _NONE, np.int32)
        more = at + 2 < len(ids)
        right[more] = pairs.merged(merged[more], ids[at[more] + 2])
        lower = np.flatnonzero((left < lowest) | (right < lowest))
        if len(lower) and lower[0] + 1 < len(at):
            at = at[: lower[0] + 1]
            merged, new, middle = _merge_at(ids, at, lowest)
        ids = new
        gone = np.ones(len(rank), bool)
        gone[at] = False
        rank = rank[gone]
        for place in (middle - 1, middle):
            place = place[(place >= 0) & (place < len(rank))]
            rank[place] = pairs.merged(ids[place], ids[place + 1])
    return ids


def _merge_at(ids: np.ndarray, at: np.ndarray, merged_id) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = ids.copy()
    out[at] = merged_id
    keep = np.ones(len(ids), bool)
    keep[at + 1] = False
    return out[at], out[keep], at - np.arange(len(at))


class Matcher:
    """All matches of a pattern in a text, with the character classes of tiktoken.

    The two regular expression engines follow different versions of Unicode. Texts with a
    character that only one of them has in a class of the pattern are cut by a
    pattern that spells out the difference; other texts by the pattern itself.
    """

    def __init__(self, pattern: str):
        import regex

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        own, odd = pattern, set()
        for name in set(regex.findall(r"\\p\{\w+\}", pattern)):
            wanted = self._members(name, every)
            held = set(regex.findall(name, every))
            odd |= wanted ^ held
            less, more = (self._class(x) for x in (held - wanted, wanted - held))
            own = own.replace(name, f"[[{name}--[{less}]]{more}]" if less else f"[{name}{more}]")
        self.plain = regex.compile(pattern).findall
        self.exact = regex.compile(own, regex.V1).findall
        self.odd = regex.compile(f"[{self._class(odd)}]").search if odd else lambda text: None

    @staticmethod
    def _members(name: str, every: str) -> set[str]:
        from tiktoken import Encoding

        found = Encoding("members", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return set(bytes(found.encode_ordinary(every)).decode())

    @staticmethod
    def _class(members: set[str]) -> str:
        """The characters as ranges."""
        points = np.array(sorted(map(ord, members)), np.int64)
        cuts = np.flatnonzero(np.diff(points) != 1) + 1
        return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in np.split(points, cuts) if len(run))

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.plain(text) if text.isascii() or not self.odd(text) else self.exact(text)


class ByteBpe:
    """Encodes arrays of texts and decodes ids; remembers the matches that it has merged, up to a bound."""

    def __init__(self, options: ByteBpeOptions):
        self.options, self.vocabulary = options, Vocabulary(options.ranks)
        self.matches = Matcher(options.pattern)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _merged(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in a row, and how many each has."""
        raw = [m.encode() for m in matches]
        sizes = np.array([len(r) for r in raw], np.int64)
        whole = np.array([self.vocabulary.ranks.get(r, -1) for r in raw], np.int32)
        counts = np.ones(len(raw), np.int64)
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        flat = self.vocabulary.single[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(sizes)
        bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        open_ = whole < 0
        long = open_ & (sizes > self.options.wide)
        rows_of: list[tuple[np.ndarray, np.ndarray]] = []
        for b in np.unique(bucket[open_ & ~long]):
            chosen = np.flatnonzero(open_ & ~long & (bucket == b))
            width = int(sizes[chosen].max())
            step = max(1, _CELLS // width)
            for k in range(0, len(chosen), step):
                part = chosen[k: k + step]
                inner = np.arange(width)
                matrix = np.full((len(part), width), -1, np.int32)
                filled = inner < sizes[part][:, None]
                matrix[filled] = flat[((ends - sizes)[part][:, None] + inner)[filled]]
                left, n = merge_rows(matrix, self.vocabulary.pairs)
                counts[part] = n
                rows_of.append((part, left[left >= 0]))
        for i in np.flatnonzero(long):
            ids = merge_long(flat[ends[i] - sizes[i]: ends[i]], self.vocabulary.pairs)
            counts[i] = len(ids)
            parts[i] = ids
        out = np.empty(counts.sum(), np.int32)
        begins = np.cumsum(counts) - counts
        out[begins[~open_]] = whole[~open_]
        for part, ids in rows_of:
            n = counts[part]
            out[np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        for i, ids in parts.items():
            out[begins[i]: begins[i] + len(ids)] = ids
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and len(texts) + 1 offsets into them. Nulls count as empty."""
        found = [self.matches(t) for t in texts.to_pylist()]
        per_text = np.array([len(f) for f in found], np.int64)
        every = [m for f in found for m in f]
        fresh = list(set(every).difference(self.slot))
        if len(self.slot) + len(fresh) > self.options.remembered:
            self.clear()
            fresh = list(set(every))
        slot, starts, ids = self.slot, self.starts, self.ids
        if fresh:
            new, counts = self._merged(fresh)
            slot = self.slot
            first = len(starts) - 1
            starts = np.concatenate([starts, starts[-1] + np.cumsum(counts)])
            ids = np.concatenate([ids, new])
            if all(len(m) <= self.options.wide for m in fresh):
                slot.update(zip(fresh, range(first, first + len(fresh))))
                self.starts, self.ids = starts, ids
            else:  # long matches are for this call only
                slot = slot | dict(zip(fresh, range(first, first + len(fresh))))
        slots = np.fromiter(map(slot.__getitem__, every), np.int64, len(every))
        counts = starts[slots + 1] - starts[slots]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        at = np.repeat(starts[slots] - ends[:-1], counts) + np.arange(ends[-1])
        return ids[at], ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, and len(offsets) offsets into them."""
        data, ends = self.vocabulary.decoded(ids)
        return data, np.concatenate([np.zeros(1, np.int64), ends])[offsets]

    def listed(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids of each text in decimal with commas between them: all in a row, and offsets."""
        comma = np.ones(len(ids), np.int64)
        comma[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = 0
        text = pc.cast(self.vocabulary.decimal.take(pa.array(ids.astype(np.int64) * 2 + comma)), pa.large_string())
        places = np.frombuffer(text.buffers()[1], np.int64, len(ids) + 1)
        return memoryview(text.buffers()[2] or b""), places[offsets]


def codec_of(options: ByteBpeOptions) -> ByteBpe:
    """The worker's encoder for these options; it outlives the task."""
    return worker_state(f"byte_bpe:{options}", lambda: ByteBpe(options))


def byte_bpe_encoded(docs: DataFrame, options: ByteBpeOptions) -> DataFrame:
    """doc_id and the ``ids`` of each text."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(options)
        for rows in sliced(batches, "text"):
            ids, offsets = codec.encode(rows.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "ids"])

    docs = texts_of(docs)
    return docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def byte_bpe_decoded(encoded: DataFrame, options: ByteBpeOptions) -> DataFrame:
    """doc_id and the bytes of its ``ids`` as ``content``; null ids count as none."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(options)
        for rows in batches:
            lists = pc.fill_null(rows.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            data, places = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            content = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), content.cast(pa.binary())], ["doc_id", "content"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, content binary")


def byte_bpe_digests(docs: DataFrame, options: ByteBpeOptions) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the listed ids and of the bytes decoded from them."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(options)
        for rows in sliced(batches, "text"):
            ids, offsets = codec.encode(rows.column("text"))
            listed, places = codec.listed(ids, offsets)
            data, bounds = codec.decode(ids, offsets)
            content = memoryview(data)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(np.diff(offsets)),
                pa.array([hashlib.sha256(listed[a:b]).hexdigest() for a, b in zip(places[:-1], places[1:])], pa.string()),
                pa.array([hashlib.sha256(content[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = texts_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
