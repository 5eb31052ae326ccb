"""Numpy block kernels of the searches: score one block of passages for all
queries of a task and keep a running top k. Imports neither Spark nor this
package, so executors need only numpy and pyarrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CELLS = 4_000_000  # scores held at once: 32 MB


class RunningBest:
    """The k best passages per query over the blocks seen so far; ties go to the smaller id.

    A score that is not finite makes no hit: one broken passage must not hide the rest of its block.
    """

    def __init__(self, query_ids: list, k: int, digits: int, positive: bool):
        self.query_ids, self.k, self.digits, self.positive = query_ids, k, digits, positive
        self.bar = np.full(len(query_ids), 0.0 if positive else -np.inf)
        self.held = [(np.empty(0), np.empty(0, dtype=object)) for _ in query_ids]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores come as one row per query and one column per passage."""
        scores = np.where(np.isfinite(scores), np.round(scores, self.digits) + 0.0, -np.inf)
        for q in np.flatnonzero(scores.max(axis=1) >= self.bar):
            fresh = scores[q]
            near = (fresh >= self.bar[q]) & (fresh > -np.inf)
            if self.positive:
                near &= fresh > 0
            old, old_ids = self.held[q]
            both = np.concatenate([old, fresh[near]])
            names = np.concatenate([old_ids, ids[near]])
            if len(both) > self.k:
                keep = both >= -np.partition(-both, self.k - 1)[self.k - 1]
                both, names = both[keep], names[keep]
            order = np.lexsort((names, -both))[: self.k]
            self.held[q] = both[order], names[order]
            if len(order) == self.k:
                self.bar[q] = both[order[-1]]

    def table(self) -> pa.Table:
        counts = [len(scores) for scores, _ in self.held]
        return pa.table({
            "query_id": pa.array(np.repeat(np.array(self.query_ids, dtype=object), counts),
                                 pa.string()),
            "passage_id": pa.array([i for _, ids in self.held for i in ids], pa.string()),
            "score": pa.array([s for scores, _ in self.held for s in scores], pa.float64()),
        })


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _owners(lists: pa.Array) -> np.ndarray:
    """For every flattened element the row it belongs to."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _chunks(rows: int, queries: int) -> list[slice]:
    step = max(1, _CELLS // max(1, queries))
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)]


class CosineScan:
    """Cosine of query vectors against blocks of (passage_id, vector).

    A hashed vector is a list of signed dimension numbers from 1; the sums
    and products of its signs are whole numbers, hence exact.
    """

    def __init__(self, queries: pa.Table, k: int, digits: int, dims: int, hashed: bool):
        self.dims, self.hashed = dims, hashed
        self.best = RunningBest(queries.column("query_id").to_pylist(), k, digits, positive=False)
        self.queries = self._matrix(_plain(queries.column("vector")))
        self.norms = self._norms(self.queries)

    def _matrix(self, vectors: pa.Array) -> np.ndarray:
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        if not self.hashed:
            return values.astype(np.float64).reshape(len(vectors), self.dims)
        cells = _owners(vectors) * self.dims + (np.abs(values) - 1)
        sums = np.bincount(cells, weights=np.sign(values), minlength=len(vectors) * self.dims)
        return sums.reshape(len(vectors), self.dims)

    @staticmethod
    def _norms(matrix: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        return np.where(norms == 0, 1.0, norms)

    def add(self, block: pa.RecordBatch | pa.Table) -> None:
        ids = np.asarray(block.column("passage_id").to_pylist(), dtype=object)
        vectors = _plain(block.column("vector"))
        for part in _chunks(len(ids), len(self.norms)):
            passages = self._matrix(vectors.slice(part.start, part.stop - part.start))
            scale = np.outer(self.norms, self._norms(passages))
            self.best.add(ids[part], self.queries @ passages.T / scale)


class TermScan:
    """BM25 of weighted query terms against blocks of (passage_id, terms, tf, damping)."""

    def __init__(self, weights: pa.Table, query_ids: list, k: int, digits: int, positive: bool):
        self.best = RunningBest(query_ids, k, digits, positive)
        places = {q: n for n, q in enumerate(query_ids)}
        coded = _plain(weights.column("term")).dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        owner = np.array([places[q] for q in weights.column("query_id").to_pylist()], dtype=int)
        self.vocabulary = coded.dictionary
        self.queries = owner[order]
        self.weights = weights.column("weight").to_numpy()[order]
        self.starts = np.searchsorted(coded.indices.to_numpy()[order],
                                      np.arange(len(self.vocabulary) + 1))

    def add(self, block: pa.RecordBatch | pa.Table) -> None:
        ids = np.asarray(block.column("passage_id").to_pylist(), dtype=object)
        lists = _plain(block.column("terms"))
        term = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        known = pc.is_valid(term).to_numpy(zero_copy_only=False)
        term = term.filter(pc.is_valid(term)).to_numpy()
        owner = _owners(lists)[known]
        tf = _plain(block.column("tf")).flatten().to_numpy(zero_copy_only=False)[known]
        part = tf / (tf + block.column("damping").to_numpy()[owner])
        for rows in _chunks(len(ids), len(self.best.query_ids)):
            inside = (owner >= rows.start) & (owner < rows.stop)
            self.best.add(ids[rows], self._scores(
                term[inside], owner[inside] - rows.start, part[inside], rows.stop - rows.start))

    def _scores(self, term: np.ndarray, owner: np.ndarray, part: np.ndarray, rows: int):
        scores = np.zeros((len(self.best.query_ids), rows))
        order = np.argsort(term, kind="stable")
        term, owner, part = term[order], owner[order], part[order]
        present, first = np.unique(term, return_index=True)
        for t, low, high in zip(present, first, np.append(first[1:], len(term))):
            asked = slice(self.starts[t], self.starts[t + 1])
            # A passage holds a term once, so no cell is hit twice in one step.
            scores[np.ix_(self.queries[asked], owner[low:high])] += np.outer(
                self.weights[asked], part[low:high])
        return scores
