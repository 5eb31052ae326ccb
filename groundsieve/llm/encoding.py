"""Token ids of whole texts, fast: every distinct piece of text between white
space is encoded once by the tokenizer and looked up afterwards.

The tokenizer never lets a token span white space, and always breaks between a
letter or digit and an ASCII symbol other than the apostrophe, so the ids of a
text are those of its pieces, one after the other. Texts where this could fail
(combining marks, which normalisation may join with their neighbours, and the
start of a special token) are handed to the tokenizer as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from groundsieve.llm.common import list_offsets, plain, worker_state

CACHE_PIECES = 400_000  # about 70 MB; a worker keeps them through the later steps of a job
_MARK = "\x01"  # encodes to one id of its own; stands between pieces
_WHOLE = r"\pM|<\||\x01"
_BREAK = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-&(-/:-@\[-`{-~])"
_GROUP = 500
SLICE = 4 * 1024 * 1024  # text bytes encoded at once


class PieceEncoder:
    """Encodes arrays of texts; keeps the ids of the pieces that it has met, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._whole([_MARK])[0]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)  # of each slot in ids
        self.ids = np.empty(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        # Many pieces make one text, with marks that show where their ids end.
        groups = [f" {_MARK} ".join(pieces[i: i + _GROUP]) + f" {_MARK}"
                  for i in range(0, len(pieces), _GROUP)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._whole(groups)])
        ends = np.flatnonzero(ids == self.mark)
        self.slot.update(zip(pieces, range(len(self.slot), len(self.slot) + len(pieces))))
        self.starts = np.concatenate(
            [self.starts, self.starts[-1] + ends + 1 - np.arange(1, len(ends) + 1)])
        self.ids = np.concatenate([self.ids, ids[ids != self.mark]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and len(texts) + 1 offsets into them. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
        split = plain(pc.ascii_split_whitespace(
            pc.replace_substring_regex(pc.ascii_lower(easy), _BREAK, r"\1 \2")))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.slot) + len(pieces) > CACHE_PIECES:
            self.clear()
        fresh = [p for p in pieces if p not in self.slot]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter((self.slot[p] for p in pieces), np.int64, len(pieces))
        slots = slots[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.starts[slots + 1] - self.starts[slots]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        at = np.repeat(self.starts[slots] - ends[:-1], counts) + np.arange(ends[-1])
        ids, offsets = self.ids[at], ends[list_offsets(split)]
        if odd.any():
            ids, offsets = self._merged(ids, offsets, odd, texts)
        return ids, offsets

    def _merged(self, ids, offsets, odd, texts):
        places = np.flatnonzero(odd)
        whole = dict(zip(places.tolist(), self._whole(texts.take(pa.array(places)).to_pylist())))
        parts = [np.array(whole[i], np.uint32) if i in whole else ids[offsets[i]: offsets[i + 1]]
                 for i in range(len(odd))]
        lengths = np.array([len(p) for p in parts], np.int64)
        return np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def encoder_of(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    return worker_state(f"encoder:{path}", lambda: PieceEncoder(path))


def with_last_id(ids: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one id behind each document."""
    out = np.insert(ids, offsets[1:], np.uint32(last))
    return out, offsets + np.arange(len(offsets))
