"""Ranked lexical search: Block-Max MaxScore over shards of compressed postings.

1. A first pass counts documents and terms. An impact is the part of a score
   that a document alone decides: (1e9 * tf) div (1000 * tf + 8 * m), with m from its length.
2. The index pass cuts what a task reads into shards of bounded size. In a shard,
   documents are numbered by id, and each term has a list: blocks of 128
   postings (gaps and counts in the fewest bytes), with the first document and the
   largest impact of each block beside them. Lists are rows of a table, sorted by term.
3. A query joins the asked terms with the lists, so lists of other terms are not
   read further, and groups by shard. The kernel searches one shard for a block of items:
   list bounds sorted upwards divide an item's lists into essential ones, whose
   documents are candidates, and others that alone cannot lift a document
   into the best k. On these, the bound of the block that would hold a
   candidate is looked at first, and the block is unpacked only if some
   candidate could still get in. Windows of documents grow, so the bar is high early.
4. The best k of all shards are merged, cut by item and salt first.

Items go in blocks, each with its own group per shard, so no group grows with the
number of items or documents.

Defined results: a null text has no terms; rows with the same doc_id are documents of
their own; a missing doc_id comes last among equal scores; items without a term of the
corpus give no rows; identical item rows are one item; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.common import list_offsets, plain, sliced, texts_of
from groundsieve.operators.topk import best
from groundsieve.sources.staging import bounded, stage

BLOCK = 128
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LISTS = ("shard long, term string, n int, firsts binary, widths binary, maxima binary, payload binary, "
          "documents binary")
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("m", "<i8")])
_PACKED = 200_000  # postings packed at once
_HITS = "item long, item_id long, doc_id long, score long"


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    shard_documents: int = 65_536     # at most, as a number of 16 bits
    shard_postings: int = 2_000_000   # a shard is closed by the document that reaches so many
    items: int = 1024                 # of a block; so many are searched together
    window: int = 512                 # documents of the first window, each next one is twice as long
    salts: int = 16


@dataclass(frozen=True)
class SearchIndex:
    """Lists and documents of all shards, and the one-row totals(n_documents, n_terms)."""

    lists: DataFrame
    totals: DataFrame


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the place of each occurrence among them, and len(texts) + 1 offsets."""
    spaced = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), f"{NO_TERM}+", " "))
    split = plain(pc.ascii_split_whitespace(spaced))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = list_offsets(split)
    empty = pc.index(coded.dictionary, pa.scalar("")).as_py()
    if empty >= 0:  # from a text that begins or ends with a space
        held = codes != empty
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])[offsets]
        codes = codes[held]
    return coded.dictionary, codes, offsets


_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _lengths(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text, from its bytes."""
    text = plain(pc.fill_null(texts, "")).cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    inside = _IN_TERM[np.frombuffer(text.buffers()[2] or b"", np.uint8)[: bounds[-1]]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    begins[first] = inside[first]
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(begins)])[bounds])


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row: n_documents with a term, and n_terms of all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for rows in sliced(batches, "text"):
            n = _lengths(rows.column("text"))
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n_documents": [documents], "n_terms": [terms]})

    parts = docs.select("text").mapInArrow(count, "n_documents long, n_terms long")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_documents", "n_terms")])


def damping(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms: 100 - 75 + ((75 * n * N) div L)."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)
    return 25 + 75 * n * documents // max(terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """Gathers documents and packs their postings."""

    def __init__(self, documents: int, terms: int):
        self.totals = documents, terms
        self.slices: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.lengths = [], []
        self.n_documents = self.n_postings = 0

    def add(self, ids: pa.Array, words: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> None:
        """Documents by their ids, with the terms of each."""
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n) + self.n_documents
        key, tf = np.unique(doc << 32 | codes, return_counts=True)
        self.slices.append((words, *(x.astype(np.int32) for x in (key >> 32, key & 0xFFFFFFFF, tf))))
        self.ids.append(ids)
        self.lengths.append(n)
        self.n_documents += len(n)
        self.n_postings += len(key)

    def packed(self, number: int) -> Iterator[pa.RecordBatch]:
        ids = pa.chunked_array(self.ids, pa.int64()).combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.zeros(len(order), _DOCUMENT)
        rows["doc_id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[order]
        rows["known"] = pc.is_valid(ids).to_numpy(zero_copy_only=False)[order]
        m = rows["m"] = damping(np.concatenate(self.lengths).astype(np.int64)[order], *self.totals)
        yield self._rows(number, pa.array([None], pa.string()), [0], *[[b""]] * 4, documents=[rows.tobytes()])
        if not self.n_postings:
            return
        every = pa.chunked_array([s[0] for s in self.slices], pa.string()).combine_chunks().dictionary_encode()
        sorted_terms = pc.sort_indices(every.dictionary).to_numpy()
        rank = np.empty(len(sorted_terms), np.int64)
        rank[sorted_terms] = np.arange(len(sorted_terms))
        term_of = rank[every.indices.to_numpy()].astype(np.int32)
        starts = np.cumsum([0, *(len(x[0]) for x in self.slices)])
        term = np.concatenate([term_of[start + codes] for start, (_, _, codes, _) in zip(starts, self.slices)])
        doc = place.astype(np.int32)[np.concatenate([x[1] for x in self.slices])]
        tf = np.concatenate([x[3] for x in self.slices])
        self.slices = []
        by = np.argsort(term.astype(np.int64) << 16 | doc)
        n = np.bincount(term, minlength=len(every.dictionary))
        terms, ends = every.dictionary.take(pa.array(sorted_terms)), np.cumsum(n)
        cuts = np.searchsorted(ends, np.arange(_PACKED, ends[-1] + _PACKED, _PACKED), "left") + 1
        for low, high in zip([0, *cuts], [*cuts[:-1], len(terms)]):
            some = by[ends[low] - n[low]: ends[high - 1]] if high > low else by[:0]
            if len(some):
                held = low + np.flatnonzero(n[low:high])  # a term of no posting comes from a slice cut in two
                yield from self._lists(number, terms.take(pa.array(held)), n[held],
                                       *(x[some].astype(np.int64) for x in (doc, tf)), m)

    def _lists(self, number, terms, n, doc, tf, m) -> Iterator[pa.RecordBatch]:
        list_end = np.cumsum(n)
        within = np.arange(len(doc)) - np.repeat(list_end - n, n)
        first = np.flatnonzero(within % BLOCK == 0)  # of each block
        sizes = np.diff(np.append(first, len(doc)))
        gap = np.diff(doc, prepend=0)
        gap[first] = 0
        gap_width = np.where(np.maximum.reduceat(gap, first) < 256, 1, 2)
        most = np.maximum.reduceat(tf, first)
        tf_width = np.where(most < 256, 1, np.where(most < 65536, 2, 4))
        maxima = np.maximum.reduceat(impacts(tf, m[doc]), first)
        block_end = np.cumsum(sizes * (gap_width + tf_width))
        block_at = block_end - sizes * (gap_width + tf_width)
        payload = np.zeros(block_end[-1], np.uint8)
        inner = np.arange(len(doc)) - np.repeat(first, sizes)
        for values, widths, at in ((gap, gap_width, block_at), (tf, tf_width, block_at + sizes * gap_width)):
            width = np.repeat(widths, sizes)
            to = np.repeat(at, sizes) + inner * width
            for byte in range(int(widths.max())):
                some = width > byte
                payload[to[some] + byte] = values[some] >> (8 * byte) & 255
        blocks = -(-n // BLOCK)
        block_bounds = np.concatenate([[0], np.cumsum(blocks)])
        payload_bounds = np.concatenate([[0], block_end[block_bounds[1:] - 1]])
        yield self._rows(
            number, terms, n, _binary(doc[first].astype("<u2"), block_bounds * 2),
            _binary((gap_width | tf_width << 4).astype(np.uint8), block_bounds),
            _binary(maxima.astype("<u4"), block_bounds * 4), _binary(payload, payload_bounds))

    @staticmethod
    def _rows(number, terms, n, firsts, widths, maxima, payload, documents=None) -> pa.RecordBatch:
        size = len(terms)
        columns = [pa.array(np.full(size, number)), terms, pa.array(n, pa.int32()), firsts, widths, maxima, payload,
                   documents or pa.nulls(size, pa.binary())]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, pa.binary()) for c in columns],
            ["shard", "term", "n", "firsts", "widths", "maxima", "payload", "documents"])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def build_search_index(docs: DataFrame, options: SearchOptions = SearchOptions()) -> SearchIndex:
    """Index of documents(doc_id, text), written to the shared folder."""
    docs = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    totals = stage(corpus_totals(docs), "search_totals")
    row = totals.first()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 24, Shard(*row)
        for rows in sliced(batches, "text"):
            words, codes, offsets = terms_of(rows.column("text"))
            start = 0
            while start < rows.num_rows:
                stop = min(rows.num_rows, start + options.shard_documents - shard.n_documents)
                part = offsets[start: stop + 1]
                shard.add(rows.column("doc_id").slice(start, stop - start), words,
                          codes[part[0]: part[-1]], part - part[0])
                start = stop
                if shard.n_documents >= options.shard_documents or shard.n_postings >= options.shard_postings:
                    yield from shard.packed(number)
                    number, shard = number + 1, Shard(*row)
        if shard.n_documents:
            yield from shard.packed(number)

    return SearchIndex(stage(docs.mapInArrow(index, _LISTS), "search_lists"), totals)


def item_terms(items: DataFrame, blocks: int) -> DataFrame:
    """item (a hash of id and text), item_id, block, term and how often the item has it."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    item = F.xxhash64("item_id", "text")
    terms = rows.select(item.alias("item"), "item_id", F.pmod(item, F.lit(blocks)).alias("block"), F.explode(
        F.regexp_extract_all(lower, F.lit(f"({_TERM})"), 1)).alias("term"))
    return terms.groupBy("item", "item_id", "block", "term").agg(F.count("*").alias("times"))


def asked_lists(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """block, term, and the ``askers`` of each: items with the weight that they give the term."""
    df = index.lists.join(_small(terms.select("term").distinct()), "term").groupBy("term").agg(
        F.sum("n").alias("df"))
    n = index.totals.select("n_documents").scalar()
    weight = F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1)))
    return terms.join(df, "term").groupBy("block", "term").agg(F.collect_list(F.struct(
        "item", "item_id", (F.col("times") * weight).alias("weight"))).alias("askers"))


def _small(rows: DataFrame) -> DataFrame:
    """The rows, broadcast if they are surely few."""
    return F.broadcast(rows) if bounded(rows, 100_000) else rows


@dataclass
class PostingList:
    """A term's list in a shard; blocks are unpacked when first needed, and then kept."""

    n: int
    firsts: np.ndarray
    widths: np.ndarray
    maxima: np.ndarray
    payload: np.ndarray
    m: np.ndarray
    docs: np.ndarray = field(init=False)
    parts: np.ndarray = field(init=False)
    open: np.ndarray = field(init=False)

    def __post_init__(self):
        self.firsts = self.firsts.astype(np.int64)
        self.docs, self.parts = np.empty(self.n, np.int32), np.empty(self.n, np.int32)
        self.open = np.zeros(len(self.firsts), bool)
        self.sizes = np.full(len(self.firsts), BLOCK)
        self.sizes[-1] = self.n - BLOCK * (len(self.firsts) - 1)
        self.gap_width, self.tf_width = self.widths & 15, self.widths >> 4
        length = self.sizes * (self.gap_width.astype(np.int64) + self.tf_width)
        self.at = np.cumsum(length) - length
        self.bound = int(self.maxima.max())

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        inner = np.arange(BLOCK)
        inside = inner < self.sizes[blocks][:, None]
        to = (blocks[:, None] * BLOCK + inner)[inside]
        gaps = self._numbers(self.at[blocks], self.gap_width[blocks], inside)
        tf = self._numbers(self.at[blocks] + self.sizes[blocks] * self.gap_width[blocks], self.tf_width[blocks], inside)
        self.docs[to] = (self.firsts[blocks][:, None] + np.cumsum(gaps, axis=1))[inside]
        self.parts[to] = impacts(tf[inside], self.m[self.docs[to]])

    def _numbers(self, at, width, inside) -> np.ndarray:
        out = np.zeros(inside.shape, np.int64)
        place = at[:, None] + np.arange(BLOCK) * width[:, None].astype(np.int64)
        for byte in range(int(width.max())):
            some = inside & (width[:, None] > byte)
            out[some] |= self.payload[place[some] + byte].astype(np.int64) << (8 * byte)
        return out

    def between(self, low: int, high: int) -> slice:
        """Places of the postings of documents from low to high, unpacked."""
        a = max(int(np.searchsorted(self.firsts, low, "right")) - 1, 0)
        b = int(np.searchsorted(self.firsts, high))
        self.unpack(np.arange(a, b))
        held = self.docs[a * BLOCK: min(b * BLOCK, self.n)]
        return slice(a * BLOCK + int(np.searchsorted(held, low)), a * BLOCK + int(np.searchsorted(held, high)))

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block that would hold it, and the most it could add."""
        block = np.searchsorted(self.firsts, docs, "right") - 1
        return block, np.where(block >= 0, self.maxima[np.maximum(block, 0)], 0).astype(np.int64)

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The impacts of documents, looked up in their blocks, which are unpacked."""
        wanted = np.unique(block[block >= 0])
        self.unpack(wanted)
        out = np.zeros(len(docs), np.int64)
        places = _flat_ranges(wanted * BLOCK, self.sizes[wanted])
        held = self.docs[places]
        at = np.searchsorted(held, docs)
        hit = (at < len(held)) & (block >= 0)
        hit[hit] = held[at[hit]] == docs[hit]
        out[hit] = self.parts[places[at[hit]]]
        return out


def _flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(lists: list[PostingList], weights: np.ndarray, documents: int,
                 options: SearchOptions) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and scores of the best k of one item, best first; of equal
    scores the smaller number."""
    bounds = np.array([x.bound for x in lists], np.int64) * weights
    order = np.argsort(bounds, kind="stable")
    lists, weights, reach = [lists[i] for i in order], weights[order], np.cumsum(bounds[order])
    best_docs, best_scores, bar = np.empty(0, np.int64), np.empty(0, np.int64), 0
    low, size = 0, options.window
    while low < documents:
        high = min(low + size, documents)
        essential = int(np.searchsorted(reach, bar, "right"))  # lists before it add up to no more than the bar
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for i in range(essential, len(lists)):
            found = lists[i].between(low, high)
            sums[lists[i].docs[found] - low] += weights[i] * lists[i].parts[found]
        docs = np.flatnonzero(sums)
        scores, docs = sums[docs], docs + low
        for i in range(essential - 1, -1, -1):
            hopeful = scores + reach[i] > bar
            docs, scores = docs[hopeful], scores[hopeful]
            if not len(docs):
                break
            block, most = lists[i].block_bounds(docs)
            hopeful = scores + weights[i] * most + (reach[i - 1] if i else 0) > bar
            docs, scores, block = docs[hopeful], scores[hopeful], block[hopeful]
            scores = scores + weights[i] * lists[i].of(docs, block)
        keep = scores > bar
        docs, scores = np.concatenate([best_docs, docs[keep]]), np.concatenate([best_scores, scores[keep]])
        first = np.lexsort((docs, -scores))[: options.k]
        best_docs, best_scores = docs[first], scores[first]
        if len(first) == options.k:
            bar = int(best_scores[-1])  # a later document has a larger number and must exceed it
        low, size = high, size * 2
    return best_docs, best_scores


def _search_group(options: SearchOptions):
    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_list = pc.is_valid(group.column("term"))
        (raw,) = group.filter(pc.invert(is_list)).column("documents").to_pylist()
        rows = np.frombuffer(raw, _DOCUMENT)
        m = rows["m"].astype(np.int64)
        asking: dict[tuple, list] = {}
        for r in group.filter(is_list).to_pylist():
            held = PostingList(r["n"], np.frombuffer(r["firsts"], "<u2"), np.frombuffer(r["widths"], np.uint8),
                               np.frombuffer(r["maxima"], "<u4"), np.frombuffer(r["payload"], np.uint8), m)
            for asker in r["askers"]:
                if asker["weight"] > 0:
                    asking.setdefault((asker["item"], asker["item_id"]), []).append((held, asker["weight"]))
        out: dict[str, list] = {"item": [], "item_id": [], "doc_id": [], "score": []}
        for (item, item_id), lists in asking.items():
            docs, scores = search_shard([x for x, _ in lists], np.array([w for _, w in lists], np.int64), len(rows), options)
            out["item"] += [item] * len(docs)
            out["item_id"] += [item_id] * len(docs)
            out["doc_id"] += [int(r["doc_id"]) if r["known"] else None for r in rows[docs]]
            out["score"] += scores.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return search


def search(index: SearchIndex, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """item_id, rank from 1, doc_id and score of the k best documents of each of
    items(item_id, text)."""
    blocks = max(1, -(-items.count() // options.items))
    terms = stage(item_terms(items, blocks), "search_terms")
    asked = stage(asked_lists(index, terms), "search_asked")
    lists = index.lists.where("term is not null").join(_small(asked), "term")
    documents = index.lists.where("term is null").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = lists.drop("documents").unionByName(documents, allowMissingColumns=True)
    hits = rows.groupBy("shard", "block").applyInArrow(_search_group(options), _HITS)
    order: tuple[Column, ...] = F.desc("score"), F.asc_nulls_last("doc_id")
    salted = best(hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(options.salts))), "place",
                  options.k, *order, by=("item", "salt"))
    ranked = best(salted.drop("salt", "place"), "place", options.k, *order, by=("item",))
    return ranked.select("item_id", (F.col("place") + 1).alias("rank"), "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    return search(build_search_index(docs, options), items, options)
