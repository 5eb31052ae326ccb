"""Numpy kernels of the posting store: one cuts passages into ranges and their terms into blocks, one
scores the blocks of a range for all queries that ask for them. Import neither Spark nor this package, so executors need
only numpy and pyarrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def blocks_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, passage_id, damping, terms, tf), those of a range in a run and in the order of
    their slots, to a row for each range: its passage_ids by slot and its blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("range").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if held and low < high and held[0].column("range")[0].as_py() != number[low]:
                yield _range_row(held)
                held = []
            if low < high:
                held.append(batch.slice(low, high - low))
    if held:
        yield _range_row(held)


def _range_row(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(pieces).combine_chunks()
    ids, terms, tf = (rows.column(c).combine_chunks() for c in ("passage_id", "terms", "tf"))
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    slot = np.repeat(np.arange(len(ids)), sizes)
    tf = tf.flatten().to_numpy(zero_copy_only=False)
    part = tf / (tf + rows.column("damping").to_numpy()[slot])
    coded = terms.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")  # slots ascend within a term
    present, first, n = np.unique(code[order], return_index=True, return_counts=True)
    slot, part = slot[order].astype(np.int16), part[order]
    bounds = pa.array(np.append(first, len(code)).astype(np.int32))
    blocks = pa.StructArray.from_arrays([
        coded.dictionary.take(pa.array(present)), pa.array(n.astype(np.int32)),
        pa.array(np.maximum.reduceat(part, first) if len(first) else part),
        pa.ListArray.from_arrays(bounds, pa.array(slot)), pa.ListArray.from_arrays(bounds, pa.array(part))],
        ["term", "n", "largest", "slots", "parts"])
    return pa.RecordBatch.from_arrays([
        pa.array([pieces[0].column("range")[0].as_py()], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.ListArray.from_arrays(pa.array([0, len(blocks)], pa.int32()), blocks)], ["range", "passage_ids", "blocks"])


def best_of_range(blocks: pa.Table, asking: pa.Table, k: int, digits: int, slots: int) -> pa.Table:
    """query_id, range, slot and score of the k best slots per query, positive ones only.

    A row of ``blocks`` is a block: the slots of a term's passages in the range and the ``parts``
    of the score that they give; a row of ``asking`` a query with its terms and their weights.
    Ties go to the smaller slot.
    """
    term = blocks.column("term").combine_chunks()
    asked, names = (asking.column(c).combine_chunks() for c in ("asked", "query_id"))
    row = pc.index_in(asked.flatten().field("term"), value_set=term)
    known = pc.is_valid(row).to_numpy(zero_copy_only=False)
    queries = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))[known]
    weights = asked.flatten().field("weight").to_numpy(zero_copy_only=False)[known]
    row = row.filter(pc.is_valid(row)).to_numpy()
    order = np.argsort(row, kind="stable")
    queries, weights = queries[order], weights[order]
    bounds = np.searchsorted(row[order], np.arange(len(term) + 1))
    held, parts = (blocks.column(c).combine_chunks() for c in ("slots", "parts"))
    starts = held.offsets.to_numpy() - (held.offsets[0].as_py() if len(held) else 0)
    slot, part = (x.flatten().to_numpy(zero_copy_only=False) for x in (held, parts))
    scores = np.zeros((len(names), slots))
    # In the order of terms, so that sums do not depend on the order of arrival.
    for row in np.argsort(np.array(term.to_pylist(), dtype=object)):
        asked, there = slice(bounds[row], bounds[row + 1]), slice(starts[row], starts[row + 1])
        scores[np.ix_(queries[asked], slot[there])] += np.outer(weights[asked], part[there])
    scores = np.round(scores, digits)
    query, at = [], []
    for q in np.flatnonzero(scores.max(axis=1, initial=0) > 0):
        order = np.lexsort((np.arange(slots), -scores[q]))[:k]
        order = order[scores[q, order] > 0]
        query.append(np.full(len(order), q))
        at.append(order)
    query, at = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (query, at))
    return pa.table({
        "query_id": names.take(pa.array(query)),
        "range": pa.array(np.full(len(query), blocks.column("range")[0].as_py() if blocks.num_rows else 0), pa.int64()),
        "slot": pa.array(at, pa.int32()), "score": pa.array(scores[query, at])})
