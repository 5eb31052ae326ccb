"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.sources.staging import shared_folder

# Text bytes that a task turns into numpy arrays at once.
SLICE_BYTES = 4 * 1024 * 1024
_STATE = "_groundsieve_worker_state"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, a null text as an empty one."""
    return docs.select(docs[key].alias(key), F.coalesce(docs[text], F.lit("")).alias(text))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def worker_state(name: str, make: Callable):
    """An object kept for the life of a Python worker, over its tasks."""
    held = sys.modules.setdefault(_STATE, types.ModuleType(_STATE))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def byte_lengths(array: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            used = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def plain(array: pa.Array) -> pa.Array:
    """The array without an offset, one chunk."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pa.concat_arrays([array])


def list_offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = hashes ^ (hashes >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def id_filter(ids: DataFrame, bits: int) -> Callable:
    """A Bloom filter of the ids in the only column, ``2 ** bits`` bits in size
    however many ids there are, as a function that drops rows of record batches
    whose id is surely not among them. Missing ids always pass."""
    (name,) = ids.columns

    def places(values: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield mixed(values.astype(np.uint64) + np.uint64(k)) & np.uint64((1 << bits) - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for at in places(batch.column(name).to_numpy()):
                np.bitwise_or.at(table, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        held = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(table[held].view(np.int64))], ["word", "set"])

    marks = ids.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias(name))
    words = marks.mapInArrow(mark, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set"))
    got = words.toArrow()  # at most 2 ** (bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def passing(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            values = batch.column(column)
            known = values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.ones(len(known), bool)
            for at in places(known):
                keep &= (held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            every = np.ones(batch.num_rows, bool)
            every[pc.is_valid(values).to_numpy(zero_copy_only=False)] = keep
            yield batch.filter(pa.array(every))

    return passing
