"""Numpy kernels of the cell index: coarse centres, assignment, bounds. Imports neither
Spark nor this package, so executors need only numpy and pyarrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ZERO = -1  # the cell of vectors without a direction


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dims)


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length one, and which of them have a direction."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norms == 0, 1.0, norms)[:, None], norms > 0


def fit_centres(rows: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres of at most ``cells`` cells, from rows in a fixed order."""
    rows, there = units(rows)
    rows = np.unique(rows[there], axis=0)
    if not len(rows):
        return np.empty((0, rows.shape[1]))
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(rows[i: i + 4096] @ centres.T, axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        moved, there = units(sums)
        centres = np.where(there[:, None], moved, centres)
    return centres


def nearest_cells(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and the angle to its centre."""
    rows, there = units(rows)
    if not len(centres):
        return np.full(len(rows), ZERO), np.zeros(len(rows))
    cosines = rows @ centres.T
    cell = np.argmax(cosines, axis=1)
    angle = np.arccos(np.clip(cosines[np.arange(len(rows)), cell], -1.0, 1.0))
    return np.where(there, cell, ZERO), np.where(there, angle, 0.0)


def cell_bounds(queries: np.ndarray, centres: np.ndarray, near: np.ndarray,
                far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and cell the cosine with the centre, and the largest cosine that a vector of
    the cell can have, its angle to the centre being between ``near`` and ``far``: angles on a
    sphere obey the triangle inequality. A query without a direction has cosine 0 with everything."""
    queries, there = units(queries)
    cosines = np.clip(queries @ centres.T, -1.0, 1.0)
    apart = np.arccos(cosines)
    least = np.maximum(0.0, np.maximum(apart - far, near - apart))
    return cosines, np.where(there[:, None], np.cos(np.minimum(least, np.pi)), 0.0)
