"""Many quotes looked for in many texts at once, by one automaton for each worker. Imports
neither Spark nor this package; needs the Aho-Corasick library.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

_HELD = "_groundsieve_automaton"


def automaton_of(name: str, quotes: list[tuple[int, str]]):
    """An automaton of (number, quote) pairs; a worker makes it once and keeps the last one."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD))
    if getattr(held, "name", None) != name:
        import ahocorasick

        held.automaton = ahocorasick.Automaton()
        for number, quote in quotes:
            held.automaton.add_word(quote, number)
        if quotes:
            held.automaton.make_automaton()
        held.name = name
    return held.automaton


def found_quotes(automaton, passages: pa.RecordBatch) -> pa.RecordBatch:
    """passage_id and number of every quote that a text of the batch holds, once each."""
    numbers, owners = [], []
    if len(automaton):
        for row, text in enumerate(passages.column("normalized_text").to_pylist()):
            held = {number for _, number in automaton.iter(text)} if text else ()
            numbers.extend(sorted(held))
            owners.extend([row] * len(held))
    return pa.RecordBatch.from_arrays(
        [passages.column("passage_id").take(pa.array(np.array(owners, np.int64))), pa.array(numbers, pa.int64())],
        ["passage_id", "number"])
