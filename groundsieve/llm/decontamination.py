"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents cuts them into passages and gathers, for the words
   of the benchmark, passage counts (for IDF) and the product of the term
   matrix's Gram matrix with a random matrix. From that one sample the leading
   singular vectors of the TF-IDF passages follow (Nystroem form of the
   randomised SVD, one pass). Benchmark texts count as passages as well and have,
   together, as much weight as the corpus, so that their own words span the space.
2. A second pass projects every window of every document and compares it with
   every benchmark piece by cosine. Projections add up over blocks of words, so a
   word is projected once however many windows it lies in.
3. Candidate windows are checked on their words: the longest common subsequence
   with the benchmark text within a stretch of about its length. ``lcs`` of the
   text's words make a leak by themselves; fewer, down to ``lcs_with_answer``, do
   if the answer (the text's last sentence) stands there word for word.

The benchmark is the query set; it is taken in blocks of ``items_per_pass``
texts, so what travels with a task is bounded.

Defined results: a null or empty document has no leak; a benchmark text without
words matches nothing, one of fewer than five words only word for word; repeated
documents are reported as often as they come; repeated benchmark rows are one;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import sliced, texts_of
from groundsieve.llm.hashing import word_codes

_SLICE = 1 << 20
_LEAK = "doc_id long, item_id long, lcs double, answer boolean, cosine double, at long"


@dataclass(frozen=True)
class LeakOptions:
    block: int = 16              # words of a block
    short_window: int = 2        # blocks of a window for pieces of up to 24 words
    long_window: int = 4         # and for longer ones
    piece: int = 48              # words of a benchmark piece
    rank: int = 56
    oversampling: int = 8
    cosine: float = 0.3          # of a candidate window
    rare: float = 0.02           # words in at most this share of all passages count as rare
    lcs: float = 0.8
    lcs_with_answer: float = 0.6
    least_words: int = 5         # shorter benchmark texts must stand word for word
    items_per_pass: int = 1000


@dataclass(frozen=True)
class Benchmark:
    """The words of one block of benchmark texts: codes 0, 1, ... of a vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: list[str]


def read_benchmark(items: pa.Table) -> Benchmark:
    ids, texts = items.column("item_id").to_pylist(), items.column("text").to_pylist()
    last = [re.split(r"(?<=[.!?])\s+|\n+", t.strip())[-1] for t in texts]
    words, codes, offsets = word_codes(pa.array(texts + last, pa.string()))
    parts = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    n = len(ids)
    answers = [a if len(a) >= 3 else w for w, a in zip(parts[:n], parts[n:])]
    return Benchmark(ids, parts[:n], answers, words.to_pylist())


def coded(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary code of every word of the texts, -1 for others, and offsets."""
    words, codes, offsets = word_codes(texts)
    known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return known[codes].astype(np.int64) if len(codes) else codes, offsets


def _stretches(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of ``width`` words each word lies in, numbered over all texts,
    and the number of the first stretch of each text, with the total at the end."""
    size = np.diff(offsets)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(-(-size // width))])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    return place // width + np.repeat(first[:-1], size), first


def _grid(codes: np.ndarray, offsets: np.ndarray, width: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes with a row for each stretch of ``width`` words, ``blank`` for
    other words and where a text ends, and the numbers of the texts' first rows."""
    stretch, first = _stretches(offsets, width)
    place = (np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))) % width
    out = np.full((int(first[-1]), width), blank, np.int64)
    out[stretch, place] = np.where(codes < 0, blank, codes)
    return out, first


def _projected(grid: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of each row's codes; the last vector is the blank's, zero."""
    out = np.zeros((len(grid), vectors.shape[1]), vectors.dtype)
    for column in grid.T:
        out += vectors[column]
    return out


def _with_blank(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def _random(words: int, options: LeakOptions) -> np.ndarray:
    return np.random.default_rng(77).standard_normal(
        (words, options.rank + options.oversampling)).astype(np.float32)


def gram_sample(grid: np.ndarray, test: np.ndarray):
    """Words that occur, their passage counts, sums of squared counts and rows of
    A'A test, for passages as rows of codes."""
    words = len(test)
    projected = _projected(grid, _with_blank(test))
    passage, place = np.nonzero(grid != words)
    codes = grid[passage, place]
    order = np.argsort(codes, kind="stable")
    there, start = np.unique(codes[order], return_index=True)
    sample = np.add.reduceat(projected[passage[order]], start) if len(there) else np.zeros((0, test.shape[1]))
    pair, count = np.unique(codes * np.int64(len(grid)) + passage, return_counts=True)
    owner = pair // max(len(grid), 1)
    return (there, np.bincount(owner, minlength=words)[there],
            np.bincount(owner, count.astype(float) ** 2, words)[there], sample)


def corpus_sample(docs: DataFrame, bench: Benchmark, options: LeakOptions):
    """Over all documents: number of passages, and for each vocabulary word its
    passage count, sum of squared counts and row of the Gram sample."""
    vocabulary, n_words = bench.vocabulary, len(bench.vocabulary)
    width = options.block * options.long_window
    columns = options.rank + options.oversampling
    schema = "word long, passages double, squares double, sample binary"

    def rows_of(passages, squares, sample):
        held = np.flatnonzero(passages)
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(passages[held]), pa.array(squares[held]),
             pa.array([r.tobytes() for r in sample[held].astype(np.float64)], pa.binary())],
            ["word", "passages", "squares", "sample"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, test = pa.array(vocabulary, pa.string()), _random(n_words, options)
        # One row more for the number of all passages.
        passages, squares = np.zeros(n_words + 1), np.zeros(n_words + 1)
        sample = np.zeros((n_words + 1, columns))
        for batch in sliced(batches, "text", _SLICE):
            codes, offsets = coded(batch.column("text"), known)
            grid, _ = _grid(codes, offsets, width, n_words)
            there, counts, square, part = gram_sample(grid, test)
            passages[there] += counts
            squares[there] += square
            sample[there] += part
            passages[-1] += len(grid)
        yield rows_of(passages, squares, sample)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, squares = np.zeros(n_words + 1), np.zeros(n_words + 1)
        sample = np.zeros((n_words + 1, columns))
        for batch in batches:
            at = batch.column("word").to_numpy()
            np.add.at(passages, at, batch.column("passages").to_numpy())
            np.add.at(squares, at, batch.column("squares").to_numpy())
            for k, raw in zip(at, batch.column("sample").to_pylist()):
                sample[k] += np.frombuffer(raw)
        yield rows_of(passages, squares, sample)

    parts = texts_of(docs).select("text").mapInArrow(gather, schema)
    total = parts.repartition(16, "word").mapInArrow(add, schema).toArrow()  # a row for each word
    passages, squares = np.zeros(n_words + 1), np.zeros(n_words + 1)
    sample = np.zeros((n_words + 1, columns))
    at = total.column("word").to_numpy()
    passages[at], squares[at] = total.column("passages").to_numpy(), total.column("squares").to_numpy()
    for k, raw in zip(at, total.column("sample").to_pylist()):
        sample[k] = np.frombuffer(raw)
    return passages[-1], passages[:-1], squares[:-1], sample[:-1]


def semantic_space(n_passages: float, passages: np.ndarray, squares: np.ndarray, sample: np.ndarray,
                   bench: Benchmark, options: LeakOptions) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each vocabulary word, its IDF times its row of the leading
    right singular vectors of the TF-IDF passages, and which words are rare."""
    words, test = len(bench.vocabulary), _random(len(bench.vocabulary), options)
    idf = np.maximum(np.log((n_passages + 1) / (passages + 0.5)), 0.05)
    lengths = np.array([len(w) for w in bench.words])
    grid, _ = _grid(np.concatenate(bench.words), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)]),
                    max(int(lengths.max()), 1), words)
    there, _, own_squares, own_sample = gram_sample(grid, test)
    own = np.zeros_like(sample)
    own[there] = own_sample
    own_energy = float((own_squares * idf[there] ** 2).sum())
    balance = max(float((squares * idf ** 2).sum()), 1.0) / max(own_energy, 1e-12)
    # (A D)' (A D) (test / D) = D A' A test, with D the IDF weights.
    image = idf[:, None] * (sample + balance * own)
    seed = test / idf[:, None]
    shift = 1e-9 * np.linalg.norm(image) + 1e-12
    image = image + shift * seed
    core = seed.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    held = values > values.max() * 1e-10
    half = image @ (vectors[:, held] / np.sqrt(values[held]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    space = (idf[:, None] * left[:, : options.rank]).astype(np.float32).reshape(words, -1)
    return space, passages <= options.rare * n_passages


def lcs_length(mask: dict[int, int], bits: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``mask`` has the places of each word."""
    full = (1 << bits) - 1
    row = full
    for word in words:
        hit = row & mask.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return bits - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for place, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | 1 << place
    return out


def _contains(words: list[int], part: list[int]) -> bool:
    first = part[0]
    return any(w == first and words[i: i + len(part)] == part for i, w in enumerate(words))


class _Checker:
    """Word checks of candidates against the benchmark texts."""

    def __init__(self, bench: Benchmark, options: LeakOptions):
        self.bench, self.options = bench, options
        self.masks = [_masks(w) for w in bench.words]
        self.held = np.zeros((len(bench.words), len(bench.vocabulary) + 1), bool)  # the last for code -1
        for n, w in enumerate(bench.words):
            self.held[n, w] = True
        self.distinct = [np.unique(w, return_counts=True) for w in bench.words]
        self.seen = np.zeros(len(bench.vocabulary) + 1, bool)

    def least(self, item: int) -> int:
        """Words of a benchmark text that its leak must have at least."""
        o, m = self.options, len(self.bench.words[item])
        return math.ceil(o.lcs_with_answer * m) if m >= o.least_words else m

    def alone(self, item: int) -> int:
        """Words that make a leak without the answer."""
        return max(self.least(item), math.ceil(self.options.lcs * len(self.bench.words[item])))

    def check(self, item: int, words: np.ndarray) -> tuple[float, bool] | None:
        """LCS share and whether the answer is there, if a stretch of the words is a leak."""
        o, m, least = self.options, len(self.bench.words[item]), self.least(item)
        # No more words can match than those that occur at all; without all words of
        # the answer, as many must as make a leak by themselves.
        self.seen[words] = True
        distinct, times = self.distinct[item]
        present = int(times[self.seen[distinct]].sum())
        answered = bool(self.seen[self.bench.answers[item]].all())
        self.seen[words] = False
        least = least if answered else self.alone(item)
        if present < least:
            return None
        masks, listed = self.masks[item], words.tolist()
        span = math.ceil(1.25 * m) + 2 if m >= o.least_words else m
        step = max(1, m // 8)
        starts = np.arange(0, max(len(listed) - span, 0) + step, step)
        inside = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.held[item][words])])
        held = inside[np.minimum(starts + span, len(listed))] - inside[np.minimum(starts, len(listed))]
        best, at = 0, 0
        for start in starts[held >= least].tolist():
            got = lcs_length(masks, m, listed[start: start + span])
            if got > best:
                best, at = got, start
        answer = self.bench.answers[item].tolist()
        near = listed[max(at - step, 0): at + span + step]
        found = _contains(near, answer)
        if best >= o.lcs * m and best >= least or best >= least and found:
            return best / m, found
        return None


def _windows(blocks: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ``width`` blocks from each block on, within its text, and a mask
    of the windows to use: all that are full, or the only one of a short text."""
    out = blocks.copy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][text] - 1
    place = np.arange(len(blocks))
    for k in range(1, width):
        inside = place + k <= last
        out[inside] += blocks[place[inside] + k]
    return out, (place + width - 1 <= last) | (place == first[:-1][text])


def find_leaks(docs: DataFrame, bench: Benchmark, space: np.ndarray, rare: np.ndarray,
               options: LeakOptions) -> DataFrame:
    """doc_id, item_id, lcs, answer, cosine and at (the word where the window begins)."""
    pieces, owners = [], []
    for n, w in enumerate(bench.words):
        for k in range(0, len(w), options.piece):
            pieces.append(w[k: k + options.piece])
            owners.append(n)
    owners = np.array(owners)
    size = np.array([len(p) for p in pieces])
    goal = np.stack([space[p].sum(0) for p in pieces])
    goal = (goal / np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    lanes = [(options.short_window, np.flatnonzero(size <= 24)), (options.long_window, np.flatnonzero(size > 24))]
    shared = docs.sparkSession.sparkContext.broadcast((bench, space, rare, goal, owners, lanes))
    width, least = options.block, options.cosine

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, space, rare, goal, owners, lanes = shared.value
        known, checker = pa.array(bench.vocabulary, pa.string()), _Checker(bench, options)
        # Necessary for a leak: of the text's rare words, as many near the window as
        # its other words leave to be found.
        rare_held = _with_blank(np.ascontiguousarray(checker.held.T[:-1] & rare[:, None]).astype(np.int16))
        common = np.array([(~rare[w]).sum() for w in bench.words])
        alone = np.array([checker.alone(k) for k in range(len(bench.words))])
        least_of = np.array([checker.least(k) for k in range(len(bench.words))])
        answers = [np.unique(a) for a in bench.answers]
        least_rare = np.minimum(alone - common, np.maximum(least_of - common, [rare[a].sum() for a in answers]))
        # Blocks that a text may reach beyond a window of its own.
        sizes = np.array([len(w) for w in bench.words])
        reach = -(-sizes // width)
        vectors_of = _with_blank(space)
        for batch in sliced(batches, "text", _SLICE):
            codes, offsets = coded(batch.column("text"), known)
            grid, first = _grid(codes, offsets, width, len(space))
            vectors = _projected(grid, vectors_of)
            # Rare words of each benchmark text in the blocks before each block.
            counts = np.concatenate([np.zeros((1, rare_held.shape[1]), np.int32), np.cumsum(
                _projected(grid, rare_held), axis=0, dtype=np.int32)])
            text_of_block = np.repeat(np.arange(len(first) - 1), np.diff(first))
            found: dict[tuple[int, int], tuple] = {}
            for blocks, lane in lanes:
                if not len(lane) or not len(vectors):
                    continue
                summed, used = _windows(vectors, first, blocks)
                norm = np.linalg.norm(summed, axis=1)
                cosine = (summed @ goal[lane].T) / np.maximum(norm, 1e-9)[:, None]
                cosine[~used] = -1
                at, piece = np.nonzero(cosine >= least)
                item, text = owners[lane[piece]], text_of_block[at]
                low = np.maximum(at - reach[item], first[text])
                high = np.minimum(at + blocks + reach[item], first[text + 1])
                enough = np.flatnonzero(counts[high, item] - counts[low, item] >= least_rare[item])
                # Windows of a text and an item whose surroundings meet are checked as one stretch.
                enough = enough[np.lexsort((at[enough], item[enough], text[enough]))]
                value = cosine[at, piece][enough]
                at, item, text = at[enough], item[enough], text[enough]
                begin = offsets[text] + (at - first[text]) * width
                low = np.maximum(begin - sizes[item], offsets[text])
                high = np.minimum(begin + blocks * width + sizes[item], offsets[text + 1])
                fresh = np.ones(len(at), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
                starts = np.flatnonzero(fresh)
                ends = np.append(starts[1:], len(at)) - 1 if len(at) else starts
                for a, b in zip(starts.tolist(), ends.tolist()):
                    n, i = int(text[a]), int(item[a])
                    if (n, i) not in found and (hit := checker.check(i, codes[low[a]: high[b]])) is not None:
                        found[n, i] = (*hit, float(value[a: b + 1].max()), int(begin[a] - offsets[n]))
            if found:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], bench.ids[i], *v) for (t, i), v in sorted(found.items())]
                yield pa.RecordBatch.from_pydict(dict(zip(
                    ("doc_id", "item_id", "lcs", "answer", "cosine", "at"), map(list, zip(*rows)))), schema=pa.schema(
                    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs", pa.float64()),
                     ("answer", pa.bool_()), ("cosine", pa.float64()), ("at", pa.int64())]))

    texts = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(search, _LEAK)


def benchmark_blocks(benchmark: DataFrame, options: LeakOptions) -> Iterator[Benchmark]:
    """The benchmark texts in blocks of bounded size, each item once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null").distinct()
    blocks = -(-items.count() // options.items_per_pass)
    for k in range(blocks):
        one = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        bench = read_benchmark(one.toArrow())
        if len(bench.vocabulary):
            yield bench


def leaks(docs: DataFrame, benchmark: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """Every document with every benchmark text that it holds."""
    out = docs.sparkSession.createDataFrame([], _LEAK)
    for bench in benchmark_blocks(benchmark, options):
        space = semantic_space(*corpus_sample(docs, bench, options), bench, options)
        out = out.unionByName(find_leaks(docs, bench, *space, options))
    return out


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without a leak; rows without an id are kept."""
    leaked = found.where("doc_id is not null").select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(leaked.hint("merge"), docs["doc_id"].cast("long") == leaked["leaked"], "left_anti")
