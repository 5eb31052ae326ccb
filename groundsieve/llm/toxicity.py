"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and
skip-grams.

Features are the words, pairs of neighbours and pairs with one or two words
between them, hashed into ``2 ** bits`` places; each counts once for a text.
Per-coordinate learning rates and the L1 term leave most weights at zero, so
what travels with the scoring tasks is a short list of places and weights, never
longer than the number of places. The model is fitted on a bounded, hash-chosen
sample of the labelled rows; every text is scored as a whole, where it lies.

Defined results: a null or empty text gets the score of the bias alone; rows
without an id are scored and count as held out; several labels of one id count
as toxic if any is; without labels, or with one kind only, the bias alone
is learnt; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.common import mixed, sliced, texts_of
from groundsieve.llm.hashing import gram_hashes, word_hashes

SKIPS = ((), (1,), (2,), (3,))  # words, neighbours, one word between, two between


@dataclass(frozen=True)
class FtrlOptions:
    bits: int = 20
    sample_rows: int = 16_384  # labelled rows to learn from, at most about so many
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    folds: int = 5             # rows with crc32(id) mod folds = 0 are held out


def held_out(key: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def feature_places(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the texts, and the text of each."""
    hashes, offsets = word_hashes(texts)
    places, owners = [], []
    for kind, steps in enumerate(SKIPS):
        got, text = gram_hashes(hashes, offsets, steps)
        places.append((mixed(got + np.uint64(kind)) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(text)
    return np.concatenate(places), np.concatenate(owners)


def fit_ftrl(examples: list[tuple[np.ndarray, int]], options: FtrlOptions) -> tuple[np.ndarray, float]:
    """Weights of all places, and the bias (which has no L1 term)."""
    n_places = 1 << options.bits
    z, n = np.zeros(n_places + 1), np.zeros(n_places + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(z[at]) - np.where(at == n_places, 0.0, options.l1), 0.0)
        return -np.sign(z[at]) * over / ((options.beta + np.sqrt(n[at])) / options.alpha + options.l2)

    for _ in range(options.epochs):
        for places, label in examples:
            at = np.append(places, n_places)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            square = error * error
            z[at] += error - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / options.alpha * w
            n[at] += square
    all_weights = weights(np.arange(n_places + 1))
    return all_weights[:-1], float(all_weights[-1])


def training_sample(docs: DataFrame, labels: DataFrame, options: FtrlOptions) -> DataFrame:
    """key, text and label of at most about ``sample_rows`` documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out(F.col("key"), options.folds))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    share = min(1.0, options.sample_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 60)) < int(share * (1 << 60)) + 1)
    texts = texts_of(docs).select(F.col("doc_id").cast("long").alias("key"), "text")
    # One text for each id, so that a much repeated id stays one example.
    return texts.join(F.broadcast(chosen), "key").groupBy("key").agg(
        F.min("text").alias("text"), F.max("label").alias("label"))


def fit_toxicity(docs: DataFrame, labels: DataFrame,
                 options: FtrlOptions = FtrlOptions()) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for rows in sliced(batches, "text"):
            places, owners = feature_places(rows.column("text"), options.bits)
            order = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[order], np.arange(rows.num_rows + 1))
            for i, (key, label) in enumerate(zip(rows.column("key").to_pylist(), rows.column("label").to_pylist())):
                examples.append((key, np.unique(places[order[cuts[i]: cuts[i + 1]]]).astype(np.int32), label))
        # The learning order depends on the ids alone, not on how rows arrive.
        spots = mixed(np.array([e[0] for e in examples], np.int64).astype(np.uint64))
        weights, bias = fit_ftrl([examples[i][1:] for i in np.argsort(spots, kind="stable")], options)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(at, -1), pa.int64()),
                                          "weight": pa.array(np.append(weights[at], bias), pa.float64())})

    sample = training_sample(docs, labels, options)
    model = sample.repartition(1).mapInArrow(train, "place long, weight double").toArrow()
    place, weight = model.column("place").to_numpy(), model.column("weight").to_numpy()
    inner = place >= 0
    return place[inner], weight[inner], float(weight[~inner].sum())


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float],
                   options: FtrlOptions = FtrlOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    place, weight, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((place.astype(np.int32), weight, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, base = shared.value
        weights = np.zeros(1 << options.bits)
        weights[at] = values
        for rows in sliced(batches, "text"):
            places, owners = feature_places(rows.column("text"), options.bits)
            hit = np.flatnonzero(weights[places])
            once = np.unique(owners[hit] << options.bits | places[hit])
            margin = base + np.bincount(once >> options.bits, weights[once & ((1 << options.bits) - 1)],
                                        minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))],
                ["doc_id", "score"])

    texts = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), options.folds).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_table(docs: DataFrame, labels: DataFrame, options: FtrlOptions = FtrlOptions()) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, options), options)
