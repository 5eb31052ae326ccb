"""Alignment of two tokenizers' tokens by inverted pair bitmaps.

1. Each text is encoded by both tokenizers. Byte offsets where tokens of both end cut
   them into groups; a link is a pair of token occurrences whose bytes overlap.
2. A task numbers its documents in blocks of bounded size. Every pair of ids has
   bitmaps over the documents of a block, one for each binary digit of the number of
   links (multiplicity planes), packed as sorted numbers of 16 bits or, where that
   takes more, as bits. Bitmaps of the slices of a block are OR-merged. A row of the postings
   table holds the bitmaps of some thousand pairs of a block.
3. Popcounts of the OR of the planes add up to the documents that hold a pair linked,
   popcounts of the planes times their weight to its links.
4. The counts go back to the blocks, one number for each pair and block, and the
   postings turn them into the sums of each document; no text is encoded again.

A pair comes once in each block at most, so a frequent pair is no hot key. What a task
holds is bounded by the size of a block.

Defined results: a text that is null, empty, or that one of the tokenizers does not give
back byte for byte has no tokens; strings of special tokens are plain text; repeated
rows and null keys are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import list_offsets, plain, sliced, texts_of, worker_state
from groundsieve.sources.staging import stage

_DENSE = 4096  # numbers of a block that take as much room as its bits
_SLICE = 1024 * 1024
_WORDS = 150_000  # that a worker keeps
# Space beside a space, or at an end; marks that a normalisation could join with their neighbours.
_ODD_SPACE = r"^ | $|[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{b}] | [\s\p{Z}\x{85}\x{1c}-\x{1f}\x{b}\pM]|▁"
_GROUPS = 64  # rows of the postings table for a block, by a hash of the pair


@dataclass(frozen=True)
class AlignmentOptions:
    first: str                        # path of a byte-level tokenizers JSON file; texts get a space before them
    second: str                       # path of a sentencepiece model, which puts that space itself
    block_documents: int = 65_536     # at most, as numbers of 16 bits
    block_postings: int = 2_000_000   # a block is closed by the slice that reaches so many


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of
    Latin-1 stand for themselves, the others follow from 256 up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Vocabulary:
    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes()


class TokenizerPair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, options: AlignmentOptions):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(options.first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=options.second)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_tokens = _Vocabulary([
            bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names])
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.b_tokens = _Vocabulary([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)])
        # Decimal ids, followed by nothing, a comma, a bar or a semicolon.
        self.decimal = pa.array(str(i) + end for n in (len(names), len(pieces)) for i in range(n) for end in ("", ",", "|", ";"))
        self.b_first = 4 * len(names)
        # Words can be encoded one by one if no token holds a space behind other bytes.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

        self.clear()

    def clear(self) -> None:
        """Forgets all words but the empty one, which has no ids."""
        self.slot = {"": 0}
        self.held = [(np.zeros(2, np.int64), np.empty(0, np.int64)) for _ in "ab"]

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers all ids in a row, and how many each text has."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out = []
        for lists in (a, self.b.encode(texts, num_threads=1)):
            n = np.array([len(x) for x in lists], np.int64)
            out.append((np.fromiter((i for x in lists for i in x), np.int64, n.sum()), n))
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes words, many as one text, and cuts the ids where the words end."""
        groups = [words[i: i + 200] for i in range(0, len(words), 200)]
        sizes = np.array([len(w.encode()) + 1 for w in words])
        known = np.ones(len(words), bool)
        found = self._whole([" ".join(g) for g in groups])
        cuts = []
        for tokens, (ids, _) in zip((self.a_tokens, self.b_tokens), found):
            ends = np.cumsum(tokens.sizes[ids])
            at = np.searchsorted(ends, np.cumsum(sizes))
            known &= (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] == np.cumsum(sizes))
            cuts.append(at + 1)
        if not known.all():  # not given back byte for byte: each by itself
            found = self._whole(words)
            cuts = [np.cumsum(n) for _, n in found]
        first = len(self.slot)
        self.slot.update(zip(words, range(first, first + len(words))))
        self.held = [(np.concatenate([starts, starts[-1] + cut]), np.concatenate([old, ids]))
                     for (starts, old), (ids, _), cut in zip(self.held, found, cuts)]

    def _encoded(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same as ``_whole``, each distinct word between single spaces encoded once: neither
        tokenizer has a token that goes on behind the end of a word. Texts with other space
        beside a space are handed over as a whole."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False) | (not self.by_word)
        split = plain(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) + len(words) > _WORDS:
            self.clear()
        fresh = [w for w in words if w not in self.slot]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter((self.slot[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        offsets = list_offsets(split)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else None
        out = []
        for side, (starts, ids) in enumerate(self.held):
            counts = starts[slots + 1] - starts[slots]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            flat = ids[np.repeat(starts[slots] - ends[:-1], counts) + np.arange(ends[-1])]
            n = np.diff(ends[offsets])
            if whole is not None:
                owner = np.repeat(np.arange(len(n)), n)
                more, lengths = whole[side]
                owners = np.concatenate([owner[~odd[owner]], np.repeat(np.flatnonzero(odd), lengths)])
                flat = np.concatenate([flat[~odd[owner]], more])[np.argsort(owners, kind="stable")]
                n[odd] = lengths
            out.append((flat, n))
        return out

    def encode(self, texts: pa.Array) -> "AlignedTexts":
        texts = pc.fill_null(texts, "")
        found = self._encoded(texts)
        raw = [(" " + t).encode() if t else b"" for t in texts.to_pylist()]
        same = np.array([len(r) > 0 for r in raw], bool)
        for tokens, (flat, n) in zip((self.a_tokens, self.b_tokens), found):
            joined, ends = tokens.joined(flat), np.concatenate([[0], np.cumsum(tokens.sizes[flat])])
            bounds = ends[np.concatenate([[0], np.cumsum(n)])]
            same &= np.array([joined[x:y] == r for x, y, r in zip(bounds[:-1], bounds[1:], raw)], bool)
        (a, n_a), (b, n_b) = ((flat[np.repeat(same, n)], np.where(same, n, 0)) for flat, n in found)
        return AlignedTexts(self, a, n_a, b, n_b)


class AlignedTexts:
    """Groups and links of texts that both tokenizers give back."""

    def __init__(self, pair: TokenizerPair, a, n_a, b, n_b):
        self.pair, self.a, self.b, self.n_a, self.n_b = pair, a, b, n_a, n_b
        end_a, end_b = np.cumsum(pair.a_tokens.sizes[a]), np.cumsum(pair.b_tokens.sizes[b])
        marks = np.zeros((end_a[-1] if len(end_a) else 0) + 1, np.uint8)
        marks[end_a] |= 1
        marks[end_b] |= 2
        common = np.cumsum(marks == 3)
        # Between two neighbouring ends lies one token of each: that is a link.
        ends = np.flatnonzero(marks)
        self.link_a = (np.cumsum(marks & 1, dtype=np.int64) - (marks & 1))[ends]
        self.link_b = (np.cumsum(marks >> 1, dtype=np.int64) - (marks >> 1))[ends]
        self.group_a, self.group_b = common[end_a - 1], common[end_b - 1]
        text_a = np.repeat(np.arange(len(n_a)), n_a)
        self.link_text = text_a[self.link_a]
        self.n_links = np.bincount(self.link_text, minlength=len(n_a))
        first = np.diff(self.group_a, prepend=-1) > 0
        self.n_groups = np.bincount(text_a[first], minlength=len(n_a))

    def listed(self) -> list[memoryview]:
        """The groups of each text as ids, `a1,a2|b1;a3|b2,b3`."""
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        in_a, in_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        place_a = np.arange(len(self.a)) + (upto_b - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + upto_a[self.group_b]
        last_a, last_b = (np.diff(g, append=groups) > 0 for g in (self.group_a, self.group_b))
        end_b = np.where(last_b, 3, 1)
        text_end = np.cumsum(self.n_b)[self.n_b > 0] - 1
        end_b[text_end] = 0
        at = np.empty(len(self.a) + len(self.b), np.int64)
        at[place_a] = self.a * 4 + np.where(last_a, 2, 1)
        at[place_b] = self.pair.b_first + self.b * 4 + end_b
        text = pc.cast(self.pair.decimal.take(pa.array(at)), pa.large_string())
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(at) + 1)
        bounds = bounds[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        data = memoryview(text.buffers()[2] or b"")
        return [data[x:y] for x, y in zip(bounds[:-1], bounds[1:])]

    def groups(self) -> list[list[dict]]:
        """The groups of each text as lists of ids."""
        out: list[list[dict]] = []
        for text in self.listed():
            parts = [g.split("|") for g in bytes(text).decode().split(";")] if len(text) else []
            out.append([{k: [int(i) for i in side.split(",")] for k, side in zip("ab", p)} for p in parts])
        return out

    def pairs(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair << 16 | document), sorted, documents numbered from ``first``, and the links of each."""
        code = self.a[self.link_a] * len(self.pair.b_tokens.sizes) + self.b[self.link_b]
        return np.unique(code << 16 | self.link_text + first, return_counts=True)


def pair_of(options: AlignmentOptions) -> TokenizerPair:
    return worker_state(f"alignment:{options}", lambda: TokenizerPair(options))


def pack_bitmaps(group: np.ndarray, numbers: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the numbers (below 65,536, ascending in each group), one after the other, and
    groups + 1 offsets. One of 8,192 bytes is a field of bits, a shorter one a list of numbers."""
    n = np.bincount(group, minlength=groups)
    dense = n >= _DENSE
    ends = np.cumsum(np.where(dense, _DENSE, n))
    bounds = np.concatenate([[0], ends])
    out = np.zeros(bounds[-1], "<u2")
    first = np.cumsum(n) - n
    to = np.repeat(bounds[:-1] - first, n) + np.arange(len(numbers))
    sparse = ~dense[group]
    out[to[sparse]] = numbers[sparse]
    for g in np.flatnonzero(dense):
        bits = np.zeros(65_536, bool)
        bits[numbers[first[g]: first[g] + n[g]]] = True
        out[bounds[g]: bounds[g + 1]] = np.packbits(bits, bitorder="little").view("<u2")
    return out, bounds


def unpack_bitmaps(packed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each number and the numbers, ascending in each group."""
    n = np.diff(bounds)
    dense = np.flatnonzero(n == _DENSE)
    if not len(dense):
        return np.repeat(np.arange(len(n)), n), packed.astype(np.int64)
    groups, numbers, at = [], [], 0
    for g in [*dense, len(n)]:
        groups.append(np.repeat(np.arange(at, g), n[at:g]))
        numbers.append(packed[bounds[at]: bounds[g]].astype(np.int64))
        if g < len(n):
            bits = np.unpackbits(packed[bounds[g]: bounds[g + 1]].view(np.uint8), bitorder="little")
            numbers.append(np.flatnonzero(bits))
            groups.append(np.full(len(numbers[-1]), g))
        at = g + 1
    return np.concatenate(groups), np.concatenate(numbers)


def by_part(place: np.ndarray, links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places with their links for each part of the pairs, sorted as they were."""
    part = (((place >> 16) * 0x9E3779B1 >> 7) % _GROUPS).astype(np.uint8)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(1, _GROUPS, dtype=np.uint8))
    return list(zip(np.split(place[order], cuts), np.split(links[order].astype(np.int32), cuts)))


def merge_or(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The OR of sorted (pair, document) places of several slices, with their links."""
    if len(parts) == 1:
        return parts[0]
    place, links = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place, kind="stable")  # runs in order: merged, not sorted anew
    place, links = place[order], links[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return (place, links) if len(first) == len(place) else (place[first], np.add.reduceat(links, first))


class Planes:
    """Bitmaps of pairs over the documents of a block, one for each digit of the number of links."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, weights: np.ndarray, packed: np.ndarray):
        """Pairs; of each plane its length in numbers of 16 bits, pair by pair; and its weight."""
        self.codes, self.sizes, self.weights, self.packed = codes, sizes, weights, packed

    @classmethod
    def of(cls, place: np.ndarray, links: np.ndarray) -> "Planes":
        code, doc = place >> 16, place & 0xFFFF
        fresh = np.diff(code, prepend=-1) > 0
        codes, pair = code[fresh], np.cumsum(fresh) - 1
        digits = max(int(links.max()).bit_length(), 1)
        key = np.concatenate([(pair * 64 + k)[links >> k & 1 == 1] for k in range(digits)])
        docs = np.concatenate([doc[links >> k & 1 == 1] for k in range(digits)])
        order = np.argsort(key, kind="stable")
        plane, group = np.unique(key[order], return_inverse=True)
        packed, bounds = pack_bitmaps(group, docs[order], len(plane))
        # A pair's first plane is marked by the sign, its weight by the digit.
        first = np.diff(plane // 64, prepend=-1) > 0
        return cls(codes, np.diff(bounds), np.where(first, -1 - plane % 64, 1 + plane % 64).astype(np.int8), packed)

    def unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all set bits: the place of the pair, the document, and the weight of the plane."""
        plane, docs = unpack_bitmaps(self.packed, np.concatenate([[0], np.cumsum(self.sizes)]))
        pair = np.cumsum(self.weights < 0) - 1
        return pair[plane], docs, np.left_shift(1, np.abs(self.weights.astype(np.int64)) - 1)[plane]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Popcounts for each pair: of the OR of its planes, and of the planes times their weights."""
        pair, docs, weight = self.unpacked()
        links = np.zeros(len(self.codes), np.int64)
        np.add.at(links, pair, weight)
        documents = np.bincount(np.unique(pair << 16 | docs) >> 16, minlength=len(self.codes))
        return documents, links


_DOC = "doc_number int, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "part int, codes binary, sizes binary, weights binary, packed binary, n_docs array<long>, n_links_of array<long>, code array<long>"


def build_postings(docs: DataFrame, options: AlignmentOptions) -> DataFrame:
    """The postings table: rows of documents (block, doc_number and their own figures) and
    rows of pairs (block, part, and the planes of the pairs in it), told apart by part."""
    docs = texts_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(options)
        block, first, held, postings = TaskContext.get().partitionId() << 24, 0, [], 0
        for rows in sliced(batches, "text", _SLICE):
            start = 0
            while start < rows.num_rows:
                part = rows.slice(start, options.block_documents - first)
                texts = pair.encode(part.column("text"))
                yield _document_rows(block, first, part.column("doc_id"), texts)
                places, links = texts.pairs(first)
                del texts  # before the next slice is encoded
                held.append(by_part(places, links))
                postings += len(places)
                key = part.column("doc_id").type
                start, first = start + part.num_rows, first + part.num_rows
                if first >= options.block_documents or postings >= options.block_postings:
                    yield from _pair_rows(block, held, key)
                    block, first, held, postings = block + 1, 0, [], 0
        if held:
            yield from _pair_rows(block, held, key)

    return docs.mapInArrow(block_rows, f"block long, {_DOC.format(kind)}, {_PAIRS}")


def _batch(block: int, size: int, key: pa.DataType, columns: dict) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "doc_number": pa.int32(), "n_docs": pa.list_(pa.int64()), "n_links_of": pa.list_(pa.int64()),
             "code": pa.list_(pa.int64()), "groups_sha256": pa.string()} | dict.fromkeys(
                 ("codes", "sizes", "weights", "packed"), pa.binary()) | dict.fromkeys(
                 ("n_a", "n_b", "n_groups", "n_links"), pa.int64()) | {"doc_id": key}
    names = ["doc_number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "part", "codes", "sizes",
             "weights", "packed", "n_docs", "n_links_of", "code"]
    filled = [columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], kinds[n]) if n in columns
              else pa.nulls(size, kinds[n]) for n in names]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *filled], ["block", *names])


def _document_rows(block: int, first: int, keys: pa.Array, texts: AlignedTexts) -> pa.RecordBatch:
    digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts.listed()]
    return _batch(block, len(keys), keys.type, {
        "doc_number": first + np.arange(len(keys)), "doc_id": plain(keys), "n_a": texts.n_a, "n_b": texts.n_b,
        "n_groups": texts.n_groups, "n_links": texts.n_links, "groups_sha256": digests})


def _pair_rows(block: int, held: list, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of pairs; slices are merged part by part, so that no second copy of the block is held."""
    for number in range(_GROUPS):
        some = [x[number] for x in held if len(x[number][0])]
        if some:
            planes = Planes.of(*merge_or(some))
            documents, of = planes.counts()
            yield _batch(block, 1, key, {
                "part": [number], "codes": [planes.codes.astype("<i8").tobytes()],
                "sizes": [planes.sizes.astype("<i4").tobytes()], "weights": [planes.weights.tobytes()],
                "packed": [planes.packed.tobytes()], "n_docs": [documents], "n_links_of": [of], "code": [planes.codes]})


def pair_counts(postings: DataFrame, options: AlignmentOptions) -> DataFrame:
    """code, a and b of each pair, the documents that hold it linked (n_docs), its links
    (n_links), and whether n_docs is the highest of its a (best, ties included)."""
    parts = postings.where("part is not null").select(F.explode(F.arrays_zip("code", "n_docs", "n_links_of")).alias("p"))
    summed = parts.groupBy(F.col("p.code").alias("code")).agg(
        F.sum("p.n_docs").alias("n_docs"), F.sum("p.n_links_of").alias("n_links"))
    size = pair_of(options).b.get_piece_size()
    counts = stage(summed.withColumns({
        "a": F.floor(F.col("code") / size), "b": F.pmod("code", F.lit(size))}), "pair_counts")
    # One row for each id of the first vocabulary at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("highest")))
    return counts.join(highest, "a").select(
        "code", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best"))


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with their sums over the scores of its pairs."""
    left, right = left.combine_chunks(), right.combine_chunks()
    docs = left.filter(pc.is_null(left.column("part")))
    docs = docs.take(pc.sort_indices(docs.column("doc_number")))
    code, n_docs = (right.column(c).to_numpy() for c in ("code", "n_docs"))
    best = right.column("best").to_numpy(zero_copy_only=False)
    order = np.argsort(code)
    code, n_docs, best = code[order], n_docs[order], best[order]
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    for row in left.filter(pc.is_valid(left.column("part"))).select(["codes", "sizes", "weights", "packed"]).to_pylist():
        planes = Planes(np.frombuffer(row["codes"], "<i8"), np.frombuffer(row["sizes"], "<i4"),
                        np.frombuffer(row["weights"], np.int8), np.frombuffer(row["packed"], "<u2"))
        pair, doc, weight = planes.unpacked()
        at = np.searchsorted(code, planes.codes)[pair]
        np.add.at(count_sum, doc, weight * n_docs[at])
        np.add.at(n_best, doc, weight * best[at])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table({n: docs.column(n) for n in names} | {
        "n_best": n_best, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})


def document_sums(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each document: its figures, n_best and count_sum."""
    pairs = postings.where("part is not null").select(F.col("block").alias("home"), F.explode("code").alias("code"))
    scores = pairs.join(counts.select("code", "n_docs", "best"), "code")
    kind = postings.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
    held = postings.drop("n_docs", "n_links_of", "code")
    return held.groupBy("block").cogroup(scores.groupBy("home")).applyInArrow(_scored, out)


def aligned_groups(docs: DataFrame, options: AlignmentOptions) -> DataFrame:
    """doc_id and the groups of its text, each with its ids of both tokenizers."""
    docs = texts_of(docs)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(options)
        for rows in sliced(batches, "text", _SLICE):
            groups = pair.encode(rows.column("text")).groups()
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(groups, kind)], ["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(align, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def alignment_table(docs: DataFrame, options: AlignmentOptions) -> DataFrame:
    postings = stage(build_postings(docs, options), "pair_postings")
    return document_sums(postings, pair_counts(postings, options))
