"""Scoring question and passage pairs with a model that a Python worker makes once. Imports
neither Spark nor this package.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_HELD = "_groundsieve_scorers"


def held_scorer(name: str, make: Callable) -> Callable:
    """The worker's scorer; it outlives the task, until another one is asked for."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD))
    if getattr(held, "name", None) != name:
        held.name, held.scorer = name, make()
    return held.scorer


def _numbers(scorer: Callable, questions: list, texts: list) -> np.ndarray:
    scores = np.array([float(x) for x in scorer(questions, texts)])
    if len(scores) != len(texts):
        raise ValueError(f"{len(scores)} scores for {len(texts)} pairs")
    return scores


def scored_batch(rows: pa.RecordBatch, scorer: Callable, batch: int) -> pa.RecordBatch:
    """Scores the pairs of a record batch, longest texts first, in calls of ``batch`` pairs."""
    ids = rows.column("query_id").to_pylist()
    questions, texts = (rows.column(c).to_pylist() for c in ("normalized_question", "text"))
    order = sorted(range(len(ids)), key=lambda i: (-len(texts[i]), ids[i], rows.column("passage_id")[i].as_py()))
    scores, errors = np.full(len(ids), np.nan), {}
    for start in range(0, len(order), batch):
        part = order[start: start + batch]
        try:
            scores[part] = _numbers(scorer, [questions[i] for i in part], [texts[i] for i in part])
        except Exception:
            for query in dict.fromkeys(ids[i] for i in part):
                own = [i for i in part if ids[i] == query]
                try:
                    scores[own] = _numbers(scorer, [questions[i] for i in own], [texts[i] for i in own])
                except Exception as failure:
                    errors[query] = f"{type(failure).__name__}: {failure}"
    failed = [errors.get(i) for i in ids]
    return pa.RecordBatch.from_arrays([
        rows.column("query_id").cast(pa.string()), rows.column("passage_id").cast(pa.string()),
        pa.array([None if e else s for s, e in zip(scores.tolist(), failed)], pa.float64()),
        pa.array(failed, pa.string())], ["query_id", "passage_id", "score", "error"])
