"""Masked pseudo-likelihood: a bidirectional window network scores documents.

The network predicts each word from the words on both sides of it: hashed
embeddings of the neighbours, one table for each side and distance, add up to a
hidden layer, and a softmax gives the class of the word. Classes cut the
words (hashed into ``2 ** word_bits`` places) by frequency into groups of about
equal mass, and a word's share of its class comes from counts over all
documents. A document's score is the sum of the log-probabilities of all its words.

1. Every text is read once and becomes the places of its words, two bytes each, in a
   written table; counting, training and scoring start from that.
2. Words are counted over all documents; partial counts are added up in Spark.
3. Rows are dealt to shards by a hash of the row, a number of shards that follows from the
   number of words. A network is trained on a small first part, so that all shards start
   from one that has learnt something, and then in rounds: in each, every shard trains on
   its part of the round, the weights (and the state of their rates) are averaged by the
   number of words predicted, slice by slice, in Spark, and the average is sent out. Over
   all rounds every word of every document is predicted once.
4. Every document is scored as a whole, where it lies.

Defined results: a null, empty or blank text has no words, score 0 and a null
mean; repeated rows get equal scores; an empty table gives no rows; other
columns are ignored. Scores do not depend on how the rows are dealt to tasks, but for
the last digits of sums that are added in another order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import mixed, plain, sliced, texts_of
from groundsieve.llm.hashing import word_hashes
from groundsieve.sources.staging import stage

_SLICE = 1 << 20
_PART = 1 << 14  # weights of a slice that is averaged at once


@dataclass(frozen=True)
class WindowOptions:
    reach: int = 2         # words on either side
    context_bits: int = 12
    word_bits: int = 16
    classes: int = 64
    width: int = 24        # of the hidden layer
    batch: int = 4096
    rate: float = 0.1
    smoothing: float = 0.5
    rounds: int = 4        # of training and averaging
    first_words: int = 400_000     # about so many teach the network that all shards start from
    shard_words: int = 2_000_000   # about so many make a shard,
    most_shards: int = 4096        # which get larger where this is reached

    @property
    def offsets(self) -> list[int]:
        return [o for o in range(-self.reach, self.reach + 1) if o]


@dataclass
class Network:
    tables: np.ndarray   # offsets x (2 ** context_bits + 1) x width; the last row stands for no word
    bias: np.ndarray
    out: np.ndarray      # width x classes
    out_bias: np.ndarray

    @classmethod
    def start(cls, o: WindowOptions) -> Network:
        rng = np.random.default_rng(3)
        tables = rng.normal(0, 0.1, (len(o.offsets), (1 << o.context_bits) + 1, o.width)).astype(np.float32)
        out = rng.normal(0, 0.1, (o.width, o.classes)).astype(np.float32)
        return cls(tables, np.zeros(o.width, np.float32), out, np.zeros(o.classes, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(values[at: at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.tables[0][context[0]] + self.bias
        for table, codes in zip(self.tables[1:], context[1:]):
            total += table[codes]
        return np.tanh(total, out=total)

    def class_logs(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits


class Trainer:
    """Adagrad steps, with one rate for each row of the embedding tables."""

    def __init__(self, o: WindowOptions):
        self.o, self.net, self.words = o, Network.start(o), 0
        self.seen = np.full(self.net.tables.shape[:2], 1e-6, np.float32)
        self.square = [np.full(p.shape, 1e-6, np.float32) for p in self.net.parts()[1:]]

    def state(self) -> np.ndarray:
        """The weights and what the rates follow from, in one row."""
        return np.concatenate([self.net.flat(), self.seen.ravel(), *(q.ravel() for q in self.square)])

    @classmethod
    def at(cls, o: WindowOptions, state: np.ndarray | None) -> Trainer:
        out = cls(o)
        if state is not None:
            out.net, at = out.net.filled(state), out.net.flat().size
            for values in (out.seen, *out.square):
                values.flat[:] = state[at: at + values.size]
                at += values.size
        return out

    def step(self, context: np.ndarray, classes: np.ndarray) -> None:
        net, n = self.net, len(classes)
        hidden = net.hidden(context)
        error = np.exp(net.class_logs(hidden))
        error[np.arange(n), classes] -= 1
        inner = (error @ net.out.T) * (1 - hidden * hidden)
        for p, square, g in zip(net.parts()[1:], self.square, (inner.sum(0), hidden.T @ error, error.sum(0))):
            square += g * g
            p -= self.o.rate * g / np.sqrt(square)
        for table, seen, codes in zip(net.tables, self.seen, context):
            order = np.argsort(codes, kind="stable")  # by digits, as the codes have 16 bits
            held = codes[order]
            start = np.flatnonzero(np.diff(held, prepend=-1))
            there = held[start]
            g = np.add.reduceat(inner[order], start)
            seen[there] += (g * g).mean(1)
            table[there] -= self.o.rate * g / np.sqrt(seen[there])[:, None]
        self.words += n


def places(texts: pa.Array, o: WindowOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its place among words and among context words; offsets of the texts."""
    hashes, offsets = word_hashes(texts)
    word = (mixed(hashes) >> np.uint64(64 - o.word_bits)).astype(np.int64)
    return word, context_places(word, o), offsets


def context_places(word: np.ndarray, o: WindowOptions) -> np.ndarray:
    return word >> (o.word_bits - o.context_bits)


def coded(docs: DataFrame, o: WindowOptions) -> DataFrame:
    """doc_id and the places of a text's words, ``words``, 16 bits each; a written table."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            word, _, offsets = places(batch.column("text"), o)
            words = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(word.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), words], ["doc_id", "words"])

    texts = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return stage(texts.mapInArrow(code, "doc_id long, words binary"), "coded_words")


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words of a batch, and the offsets of its texts."""
    column = plain(batch.column("words")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1) // 2
    return np.frombuffer(column.buffers()[2] or b"", "<u2")[: offsets[-1]].astype(np.int64), offsets


def contexts(near: np.ndarray, offsets: np.ndarray, at: np.ndarray, o: WindowOptions) -> np.ndarray:
    """The context places of the words at ``at``, a row for each offset."""
    text = np.searchsorted(offsets, at, "right") - 1
    low, high = offsets[text], offsets[text + 1]
    out = np.full((len(o.offsets), len(at)), 1 << o.context_bits, np.uint16)
    for row, step in zip(out, o.offsets):
        inside = (at + step >= low) & (at + step < high)
        row[inside] = near[at[inside] + step]
    return out


def count_words(docs: DataFrame, o: WindowOptions) -> np.ndarray:
    return count_coded(coded(docs, o), o)


def count_coded(rows: DataFrame, o: WindowOptions) -> np.ndarray:
    """How often each place among the words occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << o.word_bits, np.int64)
        for batch in batches:
            total += np.bincount(_words(batch)[0], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["place", "n"])

    rows = rows.select("words").mapInArrow(count, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).toArrow()  # at most 2 ** word_bits rows
    out = np.zeros(1 << o.word_bits, np.int64)
    out[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return out


def word_classes(counts: np.ndarray, o: WindowOptions) -> tuple[np.ndarray, np.ndarray]:
    """The class of each place and the log of its share of the class. Frequent
    words come first; a class ends when it has its part of all words."""
    mass = counts + o.smoothing
    order = np.lexsort((np.arange(len(mass)), -mass))
    middle = np.cumsum(mass[order]) - mass[order] / 2
    cls = np.empty(len(mass), np.int64)
    cls[order] = np.minimum((middle / mass.sum() * o.classes).astype(np.int64), o.classes - 1)
    return cls, np.log(mass / np.bincount(cls, mass, o.classes)[cls]).astype(np.float32)


def train(docs: DataFrame, classes: np.ndarray, o: WindowOptions) -> Network:
    rows = coded(docs, o)
    return train_coded(rows, count_coded(rows, o).sum(), classes, o)


def train_coded(rows: DataFrame, words: int, classes: np.ndarray, o: WindowOptions) -> Network:
    """The network after all rounds over the coded documents, which have so many words."""
    shared = rows.sparkSession.sparkContext.broadcast(classes.astype(np.int16))
    shards = int(min(o.most_shards, max(1, -(-words // o.shard_words))))
    number = F.pmod(F.xxhash64("doc_id", "words"), F.lit(1 << 30))
    dealt = rows.select("words", number.alias("number"), F.pmod(F.xxhash64("words", "doc_id"), F.lit(shards)).alias("shard"))
    share = int(min(1.0, o.first_words / max(words, 1)) * (1 << 30)) + 1
    first = dealt.where(F.col("number") < share).withColumn("shard", F.lit(0).cast("long"))
    state = _averaged(first, 1, None, shared, o)
    for r in range(o.rounds):
        low, high = ((1 << 30) * k // o.rounds for k in (r, r + 1))
        state = _averaged(dealt.where((F.col("number") >= low) & (F.col("number") < high)), shards, state, shared, o)
    start = Network.start(o)
    return start if state is None else start.filled(state)


def _averaged(rows: DataFrame, shards: int, state: np.ndarray | None, classes, o: WindowOptions) -> np.ndarray | None:
    """The average of the shards' networks, each trained on its rows from ``state`` on."""
    spark = rows.sparkSession
    begin = spark.sparkContext.broadcast(state)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, trainer, shard = classes.value, None, None
        for batch in batches:
            of = batch.column("shard").to_numpy()
            bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            for low, high in zip(bounds[:-1], bounds[1:]):
                if of[low] != shard:
                    yield from _slices(trainer)
                    trainer, shard = Trainer.at(o, begin.value), of[low]
                word, offsets = _words(batch.slice(low, high - low))
                near = context_places(word, o)
                for k in range(0, len(word), o.batch):
                    some = np.arange(k, min(k + o.batch, len(word)))
                    trainer.step(contexts(near, offsets, some, o), cls[word[some]])
        yield from _slices(trainer)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                one = held.setdefault(row["part"], [0, 0.0])
                one[0] += row["words"]
                one[1] = one[1] + row["words"] * np.frombuffer(row["weights"], np.float32).astype(np.float64)
        for part, (words, total) in held.items():
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "words": pa.array([words], pa.int64()),
                "weights": pa.array([(total / words).astype(np.float32).tobytes()], pa.binary())})

    schema = "part long, words long, weights binary"
    # The rows of a shard come in an order of their own, whatever task they come from.
    sorted_rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "number", "words")
    trained = sorted_rows.select("shard", "words").mapInArrow(fit, schema)
    averages = trained.repartition(32, "part").mapInArrow(add, schema).toArrow()  # one network
    got = {r["part"]: np.frombuffer(r["weights"], np.float32) for r in averages.to_pylist()}
    return np.concatenate([got[k] for k in sorted(got)]) if got else state


def _slices(trainer: Trainer | None) -> Iterator[pa.RecordBatch]:
    """What a trained network adds to the sums of the average."""
    if trainer is None or not trainer.words:
        return
    flat = trainer.state().astype(np.float32)
    for k in range(0, len(flat), _PART):
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([k // _PART], pa.int64()), "words": pa.array([trainer.words], pa.int64()),
            "weights": pa.array([flat[k: k + _PART].tobytes()], pa.binary())})


def log_probabilities(word: np.ndarray, offsets: np.ndarray, net: Network, classes: np.ndarray, shares: np.ndarray,
                      o: WindowOptions) -> np.ndarray:
    """The log-probability of every word given its neighbours."""
    near, out = context_places(word, o), np.empty(len(word), np.float32)
    for k in range(0, len(word), o.batch):
        at = np.arange(k, min(k + o.batch, len(word)))
        logs = net.class_logs(net.hidden(contexts(near, offsets, at, o)))
        out[at] = logs[np.arange(len(at)), classes[word[at]]] + shares[word[at]]
    return out


def score(docs: DataFrame, net: Network, classes: np.ndarray, shares: np.ndarray, o: WindowOptions) -> DataFrame:
    return score_coded(coded(docs, o), net, classes, shares, o)


def score_coded(rows: DataFrame, net: Network, classes: np.ndarray, shares: np.ndarray, o: WindowOptions) -> DataFrame:
    """doc_id, n_words, pll (summed log-probability) and pll_per_word."""
    shared = rows.sparkSession.sparkContext.broadcast((net.parts(), classes, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cls, share = shared.value
        network = Network(*parts)
        for batch in sliced(batches, "words", _SLICE):
            word, offsets = _words(batch)
            logs = log_probabilities(word, offsets, network, cls, share, o)
            total = np.concatenate([np.zeros(1), np.cumsum(logs, dtype=np.float64)])
            sums, n = total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets)
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(sums), mean], ["doc_id", "n_words", "pll", "pll_per_word"])

    return rows.mapInArrow(run, "doc_id long, n_words long, pll double, pll_per_word double")


def pseudo_likelihoods(docs: DataFrame, o: WindowOptions = WindowOptions()) -> DataFrame:
    rows = coded(docs, o)
    counts = count_coded(rows, o)
    classes, shares = word_classes(counts, o)
    return score_coded(rows, train_coded(rows, int(counts.sum()), classes, o), classes, shares, o)
