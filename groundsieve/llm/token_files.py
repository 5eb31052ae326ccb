"""Token-id files: a shared zstandard dictionary, one compressed frame for each
document, and an index that finds a document without reading the others.

A shard file holds a header (magic, width of an id, SHA-256 of the dictionary),
the frames in ascending document order, an index of fixed-width rows (key, null
flag, place and size of the frame, number of ids) and a footer with the place of
the index. The dictionary is trained on a bounded sample of serialised id arrays
and lies beside the shards under its hash.

Writing: documents are range-partitioned by key, so the shards follow each
other in key order; a task writes its shards under names of their own and
returns a manifest row for each. Only manifest rows of successful tasks are
kept, so files of failed attempts are never read.

Defined results: a null text is empty and holds the end id alone; null keys come
first; repeated keys are all kept, ordered by the hash of their texts; an empty
table gives a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from groundsieve.llm.common import file_system, new_folder, sliced, texts_of
from groundsieve.llm.encoding import SLICE, encoder_of, with_last_id
from groundsieve.sources.staging import stage

MAGIC = b"GSTOKEN1"
_HEADER = "<8sB32s"
_FOOTER = "<QQ8s"
_INDEX = np.dtype([("key", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u4")])
_MANIFEST = "part int, file int, path string, documents long, ids long, bytes long"


@dataclass(frozen=True)
class TokenFileOptions:
    tokenizer: str                       # path of a tokenizers JSON file
    end_id: int = 2
    sample_documents: int = 2000         # at most about so many train the dictionary
    sample_bytes: int = 8 * 1024 * 1024  # and at most so many serialised bytes of them
    dictionary_bytes: int = 64 * 1024
    level: int = 3
    shard_bytes: int = 64 * 1024 * 1024
    id_width: int = 2                    # bytes of a stored id; 4 for vocabularies beyond 65,536


@dataclass(frozen=True)
class TokenFiles:
    """Manifest (one row for each shard file), the dictionary's hash and its path."""

    manifest: DataFrame
    dictionary_hash: str
    dictionary_path: str


def encoded_slices(batches, options: TokenFileOptions):
    """Record batch slices with the ids of their texts and the offsets of each document."""
    encoder = encoder_of(options.tokenizer)
    for rows in sliced(batches, "text", SLICE):
        yield rows, *with_last_id(*encoder.encode(rows.column("text")), options.end_id)


def train_dictionary(texts: DataFrame, options: TokenFileOptions) -> bytes:
    """A zstandard dictionary of a hash-chosen, bounded sample; empty for an empty table."""
    total = texts.count()
    share = min(1.0, options.sample_documents / max(total, 1))
    spot = F.pmod(F.xxhash64(*texts.columns), F.lit(1 << 60))
    sample = texts.where(spot < int(share * (1 << 60)) + 1).select("text").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        samples, used = [], 0
        for _, ids, offsets in encoded_slices(batches, options):
            raw = ids.astype(f"<u{options.id_width}")
            for a, b in zip(offsets[:-1], offsets[1:]):
                if used < options.sample_bytes:
                    samples.append(raw[a:b].tobytes())
                    used += len(samples[-1])
        try:
            data = zstandard.train_dictionary(options.dictionary_bytes, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few samples to train on
            data = b"".join(samples)[-options.dictionary_bytes:]
        yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

    rows = sample.mapInArrow(train, "data binary").collect()  # one row of bounded size
    return bytes(rows[0].data) if rows else b""


def _zstd_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class _ShardWriter:
    def __init__(self, folder: str, dictionary: bytes, options: TokenFileOptions, part: int):
        import zstandard

        self.fs, self.folder = file_system(folder)
        self.scheme, self.options, self.part = folder[: len(folder) - len(self.folder)], options, part
        self.hash = hashlib.sha256(dictionary).digest()
        self.zstd = zstandard.ZstdCompressor(level=options.level, dict_data=_zstd_dictionary(dictionary))
        self.out, self.files = None, 0

    def add(self, key: int | None, ids: np.ndarray) -> dict | None:
        """Writes a document; returns a manifest row if that filled the shard."""
        if self.out is None:
            self.path = f"{self.folder}/shard-{self.part:06d}-{self.files:04d}-{uuid.uuid4().hex}.gst"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.index, self.ids = self.fs.open_output_stream(self.path, compression=None), [], 0
            self.out.write(struct.pack(_HEADER, MAGIC, self.options.id_width, self.hash))
            self.at = struct.calcsize(_HEADER)
        frame = self.zstd.compress(ids.astype(f"<u{self.options.id_width}").tobytes())
        self.out.write(frame)
        self.index.append((key or 0, key is None, self.at, len(frame), len(ids)))
        self.at += len(frame)
        self.ids += len(ids)
        return self.close() if self.at >= self.options.shard_bytes else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        index = np.array(self.index, _INDEX).tobytes()
        self.out.write(index)
        self.out.write(struct.pack(_FOOTER, self.at, len(self.index), MAGIC))
        self.out.close()
        self.out = None
        self.files += 1
        return {"part": self.part, "file": self.files - 1, "path": self.scheme + self.path,
                "documents": len(self.index), "ids": self.ids,
                "bytes": self.at + len(index) + struct.calcsize(_FOOTER)}


def write_token_files(docs: DataFrame, options: TokenFileOptions, key: str = "doc_id",
                      text: str = "text") -> TokenFiles:
    """Encodes all texts and writes them as shards in ascending key order."""
    spark = docs.sparkSession
    texts = texts_of(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dictionary = train_dictionary(texts, options)
    folder = new_folder(spark, "token-files")
    name = hashlib.sha256(dictionary).hexdigest()
    fs, inner = file_system(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/{name}.zdict", compression=None) as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _ShardWriter(folder, dictionary, options, TaskContext.get().partitionId())
        rows = []
        for batch, ids, offsets in encoded_slices(batches, options):
            for n, one in enumerate(batch.column("key").to_pylist()):
                rows.append(writer.add(one, ids[offsets[n]: offsets[n + 1]]))
        rows = [r for r in [*rows, writer.close()] if r]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_manifest_schema())

    # The hash of the text splits a key that many rows share, and orders its rows.
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc()]
    dealt = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order)
    manifest = stage(dealt.sortWithinPartitions(*order).select("key", "text").mapInArrow(
        write, _MANIFEST), "token-manifest")
    return TokenFiles(manifest, name, f"{folder}/{name}.zdict")


def _manifest_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()),
                      ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


class TokenFile:
    """Reads one shard: the index first, then any frame by itself."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        magic, self.width, used = struct.unpack(_HEADER, self.file.read_at(struct.calcsize(_HEADER), 0))
        at, rows, end = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"not a token file: {path}")
        if used != hashlib.sha256(dictionary).digest():
            raise ValueError(f"written with another dictionary: {path}")
        self.index = np.frombuffer(self.file.read_at(rows * _INDEX.itemsize, at), _INDEX)
        self.zstd = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(dictionary))

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        raw = self.zstd.decompress(self.file.read_at(int(entry["size"]), int(entry["at"])))
        ids = np.frombuffer(raw, f"<u{self.width}")
        if len(ids) != entry["ids"]:
            raise ValueError("a frame does not hold the ids that the index names")
        return ids

    def find(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key; reads their frames only."""
        rows = np.flatnonzero((self.index["key"] == key) & (self.index["null"] == 0))
        return [self.ids(r) for r in rows]


def read_dictionary(path: str) -> bytes:
    fs, inner = file_system(path)
    with fs.open_input_stream(inner, compression=None) as source:
        return source.read()


def read_token_files(files: TokenFiles, with_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """Every document of the shards: key, ``start`` (ids of all documents before
    it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers) and, if asked for, the ``ids``."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards = files.manifest.sparkSession.sparkContext.defaultParallelism * 4
    dictionary_path = files.dictionary_path
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    arrow = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                       ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for shard in batch.to_pylist():
                dictionary = read_dictionary(dictionary_path) if dictionary is None else dictionary
                source = TokenFile(shard["path"], dictionary)
                start, rows, held = shard["before"], [], 0
                for n, entry in enumerate(source.index):
                    ids = source.ids(n)
                    row = {key: None if entry["null"] else int(entry["key"]), "start": start,
                           "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    rows.append(row | {"ids": ids.astype(np.int64)} if with_ids else row)
                    start += len(ids)
                    held += len(ids) * with_ids + 16
                    if held > 2_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return starts.repartition(shards, "path").mapInArrow(read, schema)


def token_digests(docs: DataFrame, options: TokenFileOptions) -> DataFrame:
    """Writes the documents as token files, reads the files back and returns
    their digests."""
    return read_token_files(write_token_files(docs, options), with_ids=False)


