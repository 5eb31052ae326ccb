"""Best-fit decreasing packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens; pieces are dealt to
partitions of bounded size, each packed by best fit decreasing. Dual-feasible
functions give a lower bound on the number of sequences of each partition. Where
the packing meets the bound it is certified optimal and only its emptiest
sequence stays open; where a gap remains, all sequences that are not nearly full
stay open. The pieces of open sequences of several partitions meet in one
partition of the next round, and best fit decreasing runs again, until one
partition is left. No partition of any round is expected to have more than
``partition_pieces`` pieces: where more than half of a round's pieces stay open and
would not fit fewer partitions, the next round closes all; ``bins`` - ``bound`` of
its partitions is the gap that remains.

Defined results: a null text is empty and makes a piece of the end id alone; a
repeated row is packed as often as it comes; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import sliced, texts_of
from groundsieve.llm.encoding import SLICE, encoder_of, with_last_id
from groundsieve.sources.staging import stage

_ROUNDINGS = 100  # pieces a sequence up to which rounding functions are tried


@dataclass(frozen=True)
class PackingOptions:
    tokenizer: str                 # path of a tokenizers JSON file
    end_id: int = 1
    capacity: int = 4096
    partition_pieces: int = 50_000  # expected pieces of a partition, at most
    merge: int = 16                 # partitions that meet in one of the next round
    nearly_full: float = 0.995      # sequences that stay closed where a gap remains


def document_pieces(docs: DataFrame, options: PackingOptions, with_ids: bool = False,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = [key, "piece", "start", "length", "ids_crc32"]
    schema = f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    capacity, tokenizer, end_id = options.capacity, options.tokenizer, options.end_id

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in sliced(batches, "text", SLICE):
            ids, ends = with_last_id(*encoder.encode(batch.column("text")), end_id)
            size = np.diff(ends)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = ends[doc] + start
            crc = [zlib.crc32(raw[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [batch.column("key").take(pa.array(doc)), piece.astype(np.int32), start, length, crc]
            columns = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_ids:
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
                columns.append(pa.ListArray.from_arrays(
                    pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    texts = texts_of(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the room left in each bin. Of the bins
    with the least sufficient room the latest is taken."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if some bin has r tokens of room
    for n in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[n])
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            one = by_room[left].pop()
            if not by_room[left]:
                open_rooms &= ~(1 << left)
        else:
            one, left = len(room), capacity
            room.append(0)
        bins[n], offsets[n] = one, capacity - left
        room[one] = left - size
        if room[one]:
            by_room[room[one]].append(one)
            open_rooms |= 1 << room[one]
    return bins, offsets, room


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: the largest bound of two
    families of dual-feasible functions. The first ones, for each k, lift sizes above
    capacity - k to the capacity and drop those below k. The second ones round: for
    each k, a size s counts (k + 1) s / capacity rounded down, of k, or s / capacity
    itself if that is a whole number; they certify k pieces a sequence where all are
    a little larger than capacity / (k + 1)."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    number = np.concatenate([[0], np.cumsum(counts)])             # pieces with size < s
    tokens = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    k = np.arange(0, capacity // 2 + 1)
    lifted = number[-1] - number[capacity - k + 1]                # sizes above capacity - k
    between = tokens[capacity - k + 1] - tokens[k]                # sizes from k to capacity - k
    best = int((lifted + -(-between // capacity)).max())
    sizes = np.flatnonzero(counts)
    held = counts[sizes]
    for k in range(1, min(capacity, _ROUNDINGS) + 1):
        parts, rest = np.divmod((k + 1) * sizes, capacity)
        # In units of 1 / (k * capacity).
        total = int((held * np.where(rest == 0, k * sizes, parts * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def _pack_group(group: pa.Table, level: int, last: bool, capacity: int, nearly_full: float) -> pa.Table:
    lengths = group.column("length").to_numpy()
    # The content decides the order, not the order of arrival.
    order = np.lexsort([group.column(c).to_numpy() for c in ("tie", "piece", "length")])
    lengths = lengths[order]
    bins, offsets, room = best_fit_decreasing(lengths, capacity)
    room, bound = np.array(room), bin_bound(lengths, capacity)
    closed = np.ones(len(room), bool)
    if not last:
        if len(room) > bound:
            closed = room <= (1 - nearly_full) * capacity
        closed[np.argmax(room)] = False
    number = int(group.column("part")[0].as_py())
    sequence = (level << 56) + (number << 24) + bins
    put = closed[bins]
    out = group.take(pa.array(order))
    for name, values in (("sequence_id", sequence), ("offset", offsets)):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, pa.int64(), mask=~put))
    certificate = np.full(len(put), bound), np.full(len(put), len(room))
    for name, values in zip(("bound", "bins"), certificate):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    return out


def _group_packer(level: int, last: bool, capacity: int, nearly_full: float):
    def one(group):
        return _pack_group(group, level, last, capacity, nearly_full)

    return one


def pack(pieces: DataFrame, options: PackingOptions) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, and with the certificate
    of the partition that placed them: its ``bound`` and its number of ``bins``.

    ``pieces`` has a ``length`` from 1 to ``capacity`` and a ``piece`` number;
    its other columns are kept."""
    none = F.lit(None).cast("long")
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "bound", "bins")]
    tie = F.xxhash64(*own)
    rows = pieces.select(*own, tie.alias("tie"))
    rows = stage(rows, "pieces")
    held = rows.count()
    parts = max(1, -(-held // options.partition_pieces))
    for name in ("sequence_id", "offset", "bound", "bins"):
        rows = rows.withColumn(name, none)
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    schema, done, level, last = rows.schema, None, 0, parts == 1
    capacity, full = options.capacity, options.nearly_full
    while True:
        # Spread by hash and a random salt, so that copies of a row do not meet in one partition.
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(
            F.lit(level), "tie", F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
        packed = stage(dealt.groupBy("part").applyInArrow(
            _group_packer(level, last, capacity, full), schema), f"packed-{level}")
        placed = packed.where("sequence_id is not null")
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done.select(*own, "sequence_id", "offset", "bound", "bins")
        rows, level = packed.where("sequence_id is null"), level + 1
        left = rows.count()
        fewer, needed = -(-parts // options.merge), -(-left // options.partition_pieces)
        # Where exchange does not help, it ends: partitions stay as small as in the first round.
        parts = max(1, fewer, needed)
        last = parts == 1 or (needed > fewer and 2 * left > held)
        held = left


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids, one row for each sequence (of at most ``capacity``
    ids); needs pieces with ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, options: PackingOptions) -> DataFrame:
    """All documents as pieces with their place in a sequence."""
    return pack(document_pieces(docs, options), options).drop("bound", "bins")
