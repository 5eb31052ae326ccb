"""Word hashes of whole texts: every distinct word of a batch is hashed once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from groundsieve.llm.common import list_offsets, mixed, plain

PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…*_-"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in lower case without outer punctuation, the place of each
    word of the texts among them, and len(texts) + 1 offsets. A text's words are
    what stands between ASCII white space; those of punctuation alone are left out."""
    split = plain(pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    raw = split.flatten().dictionary_encode()
    trimmed = pc.utf8_trim(raw.dictionary, characters=PUNCTUATION).dictionary_encode()
    codes = trimmed.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)]
    empty = pc.index(trimmed.dictionary, pa.scalar("")).as_py()
    offsets = list_offsets(split)
    if empty >= 0:
        held = codes != empty
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])[offsets]
        codes = codes[held]
    return trimmed.dictionary, codes.astype(np.int64), offsets


def string_hashes(words: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of an array of strings."""
    from pandas.util import hash_array

    return hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.empty(0, np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the offsets of each text."""
    words, codes, offsets = word_codes(texts)
    return string_hashes(words)[codes], offsets


def gram_hashes(hashes: np.ndarray, offsets: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams or skip-grams, and the text of each: words at i,
    i + steps[0], i + steps[1] and so on, all within one text."""
    reach = steps[-1] if steps else 0
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), np.maximum(size - reach, 0))
    inner = np.maximum(size - reach, 0)
    start = np.arange(len(text)) - np.repeat(np.cumsum(inner) - inner, inner) + np.repeat(offsets[:-1], inner)
    out = hashes[start]
    for step in steps:
        out = mixed(out * _MIX + hashes[start + step])
    return out, text
