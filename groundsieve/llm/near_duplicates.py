"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. One pass over the texts sketches each: a 128-bit key of its words and a hash
   for each band of MinHash values. Band and row counts follow from the wanted
   recall at the threshold.
2. Texts of one key are copies and become one unit. Units that share a
   band bucket are tied to the smallest of the bucket, and connected components
   of these ties hold every candidate pair; no pair is written down.
3. In each component all pairs are verified on the full sets of word n-grams,
   block against block in numpy. A component larger than a block is cut into
   a grid of blocks, each pair of blocks being a task of bounded size that sends
   back counts of links and a spanning forest of them, not the links.
4. Components of the verified links are the classes.

Defined results: words are in lower case without outer punctuation; a text with
fewer than n words has one n-gram, all of its words; texts without words are
copies of each other; a null text is empty. ``class_id`` is the smallest id of
the class, null only if no row of it has one; repeated rows are copies; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import id_filter, mixed, sliced, texts_of
from groundsieve.llm.graph import components
from groundsieve.llm.hashing import gram_hashes, word_hashes
from groundsieve.sources.staging import stage

_SLICE = 1 << 20
_COLUMNS = 2048  # n-grams of a block multiplied at once


@dataclass(frozen=True)
class JaccardOptions:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995    # of pairs right at the threshold
    most_hashes: int = 128
    block: int = 1000         # units of a block of the grid
    filter_bits: int = 26     # of the filter of ids, 8 MB; a full one only lets more texts through
    bin_units: int = 2000     # units of small components that one task verifies, on average


def band_shape(options: JaccardOptions) -> tuple[int, int]:
    """Bands and rows: the most rows for which the recall can be met."""
    best = None
    for rows in range(1, 33):
        p = options.threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - options.recall) / math.log1p(-p))
        if bands * rows <= options.most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes, their text, and word hashes with offsets."""
    hashes, offsets = word_hashes(texts)
    grams, owner = gram_hashes(hashes, offsets, tuple(range(1, n)))
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        one = [mixed(np.array([hash(tuple(hashes[offsets[i]: offsets[i + 1]].tolist())) & (2 ** 64 - 1)], np.uint64))[0]
               for i in short]
        grams, owner = np.concatenate([grams, np.array(one, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner, hashes, offsets


def _text_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each text's sequence of words."""
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    place = mixed(place.astype(np.uint64) + np.uint64(1))
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ (place + np.uint64(salt))))])
        keys.append((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64))
    return keys[0], keys[1]


def _bands(grams: np.ndarray, owner: np.ndarray, texts: int, bands: int, rows: int) -> np.ndarray:
    """A hash for each text and band; texts without n-grams get zeros."""
    rng = np.random.default_rng(20_240_517)
    factors = rng.integers(1, 2 ** 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2 ** 63, bands * rows, np.uint64)
    out = np.zeros((texts, bands), np.uint64)
    there, first = np.unique(owner, return_index=True)
    if not len(there):
        return out.astype(np.int64)
    low = grams >> np.uint64(32)
    for band in range(bands):
        key = np.full(len(there), band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(
                (low * factors[k] + shifts[k]) >> np.uint64(32), first))
        out[there, band] = key
    return out.view(np.int64)


def sketches(docs: DataFrame, options: JaccardOptions) -> DataFrame:
    """doc_id, k1, k2 (the key of the words) and bands of every document."""
    bands, rows, n = *band_shape(options), options.n

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            grams, owner, hashes, offsets = _shingles(batch.column("text"), n)
            k1, k2 = _text_keys(hashes, offsets)
            values = _bands(grams, owner, batch.num_rows, bands, rows)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(k1), pa.array(k2),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))],
                ["doc_id", "k1", "k2", "bands"])

    texts = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(sketch, "doc_id long, k1 long, k2 long, bands array<long>")


def candidate_components(units: DataFrame) -> DataFrame:
    """node (a unit) and label of the units that share a bucket with another one."""
    buckets = stage(units.select("unit", F.posexplode("bands").alias("band", "value")).select(
        "unit", F.xxhash64("band", "value").alias("bucket")), "buckets")
    leads = stage(buckets.groupBy("bucket").agg(F.min("unit").alias("lead"), F.count("*").alias("n")).where(
        "n > 1").select("bucket", "lead"), "leads")
    # Merged at every size, so that the plan and its shuffles grow evenly.
    ties = buckets.join(leads.hint("merge"), "bucket").where("unit <> lead").select(
        F.col("lead").alias("a"), F.col("unit").alias("b"))
    return components(ties)


def gram_sets(docs: DataFrame, wanted: DataFrame, options: JaccardOptions) -> DataFrame:
    """unit, label, blocks and grams (sorted distinct n-gram hashes) of the wanted units,
    from the texts of their first documents; a unit may come up several times."""
    n = options.n

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(passing(batches, "doc_id"), "text", _SLICE):
            grams, owner, hashes, offsets = _shingles(batch.column("text"), n)
            k1, k2 = _text_keys(hashes, offsets)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            once = np.unique(np.stack([k1, k2]), axis=1, return_index=True)[1]
            sets = [np.unique(grams[cuts[i]: cuts[i + 1]]).tobytes() for i in once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[once]), pa.array(k2[once]), pa.array(sets, pa.binary())], ["k1", "k2", "grams"])

    # Only texts that pass the filter are read as sets; the join by words decides.
    passing = id_filter(wanted.select("first_id"), options.filter_bits)
    texts = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.mapInArrow(collect, "k1 long, k2 long, grams binary")
    # Merged at every size, as above.
    return found.join(wanted.hint("merge"), ["k1", "k2"]).select("unit", "label", "blocks", "grams")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, all left against all right."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for side in (left, right):
        sides.append((np.concatenate(side) if side else np.empty(0, np.uint64),
                      np.repeat(np.arange(len(side)), [len(s) for s in side])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(shared, values)
        held = at < len(shared)
        held[held] = shared[at[held]] == values[held]
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], owner[held][order]))
    for start in range(0, len(shared), _COLUMNS):
        matrices = []
        for (at, owner), side in zip(placed, (left, right)):
            a, b = np.searchsorted(at, (start, start + _COLUMNS))
            m = np.zeros((len(side), min(_COLUMNS, len(shared) - start)), np.float32)
            m[owner[a:b], at[a:b] - start] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    both = intersections(left, right)
    sizes = [np.array([len(s) for s in side], np.float32) for side in (left, right)]
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return (both >= np.float32(threshold) * union * (1 - 1e-6)) & (union > 0)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each index of a symmetric matrix."""
    root = np.arange(len(linked))
    while True:
        spread = np.array([min(root[i], root[row].min()) if (row := linked[i]).any() else root[i]
                           for i in range(len(linked))])
        spread = spread[spread]
        if (spread == root).all():
            return root
        root = spread


def _verify_block(units: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float):
    """Links and root of each unit; ``side`` is 0 and 1 for two blocks that meet,
    all 0 for a block with itself."""
    if side.any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cross = similar([sets[i] for i in a], [sets[i] for i in b], threshold)
        linked = np.zeros((len(units), len(units)), bool)
        linked[np.ix_(a, b)] = cross
        linked |= linked.T
    else:
        linked = similar(sets, sets, threshold)
        np.fill_diagonal(linked, False)
    return linked.sum(1), units[_roots(linked)]


def verify(sets: DataFrame, units: int, options: JaccardOptions) -> DataFrame:
    """unit, links and root: for each block a unit was verified in, its links
    there and the smallest unit that it is tied to by them. ``units`` is their number."""
    threshold = options.threshold
    bins = max(1, -(-units // options.bin_units))
    # A unit of block i meets the blocks j of its component in the cells (smaller, larger);
    # components of one block share cells.
    own = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    met = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "unit", "label", "grams", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(
            F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"))
    # The sets move to their cells once; copies of a unit go there.
    cells = met.repartition("cell").groupBy("cell", "label", "i", "j", "side", "unit").agg(
        F.any_value("grams").alias("grams"))

    def run(group):
        keys = np.stack([group.column(c).to_numpy() for c in ("label", "i", "j")])
        order = np.lexsort((group.column("unit").to_numpy(), *keys[::-1]))
        keys = keys[:, order]
        units, side = group.column("unit").to_numpy()[order], group.column("side").to_numpy()[order]
        raw = group.column("grams").to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            sets = [np.frombuffer(raw[k], np.uint64) for k in order[a:b]]
            out.append((units[a:b], *_verify_block(units[a:b], sets, side[a:b], threshold)))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("unit", "links", "root"), columns)})

    return cells.groupBy("cell").applyInArrow(run, "unit long, links long, root long")


def unit_table(sketched: DataFrame) -> DataFrame:
    """unit, k1, k2, first_id (smallest id), n (documents) and bands of each distinct text."""
    return stage(sketched.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")
    ).withColumn("unit", F.monotonically_increasing_id()), "units")


def linked_units(docs: DataFrame, units: DataFrame, options: JaccardOptions) -> tuple[DataFrame, DataFrame]:
    """(unit, n_links) of the units that have links, and (node, label): the
    components of the verified links."""
    candidates = stage(candidate_components(units), "candidates")
    # The sizes of components come from these numbers, so that the sets are read and moved once.
    sizes = candidates.groupBy("label").agg(F.ceil(F.count("*") / options.block).cast("int").alias("blocks"))
    wanted = stage(units.join(candidates.join(sizes, "label").withColumnRenamed("node", "unit"), "unit").select(
        "unit", "label", "blocks", "k1", "k2", "first_id"), "wanted")
    verified = stage(verify(gram_sets(docs, wanted, options), wanted.count(), options).where("links > 0"), "verified")
    links = verified.groupBy("unit").agg(F.sum("links").alias("n_links"))
    return links, components(verified.select(F.col("root").alias("a"), F.col("unit").alias("b")))


def classes_of_units(docs: DataFrame, units: DataFrame, options: JaccardOptions) -> DataFrame:
    """k1, k2, class (a number), class_id (smallest document id) and n_links of each unit."""
    links, groups = linked_units(docs, units, options)
    label = F.coalesce(F.col("label"), F.col("unit")).alias("class")
    placed = stage(units.select("unit", "k1", "k2", "first_id", "n").join(
        groups.withColumnRenamed("node", "unit"), "unit", "left").join(links, "unit", "left").select(
        "k1", "k2", "first_id", "n", label, F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed-units")
    first = placed.groupBy("class").agg(F.min("first_id").alias("class_id"))
    return stage(placed.join(first, "class"), "classes")


def near_duplicate_classes(docs: DataFrame, options: JaccardOptions = JaccardOptions()) -> DataFrame:
    """doc_id, class_id, n_links (different texts with a similarity from the
    threshold on) and n_copies (other documents with the same words) of every document."""
    sketched = stage(sketches(docs, options), "sketches")
    classes = classes_of_units(docs, unit_table(sketched.select("doc_id", "k1", "k2", "bands")), options)
    return sketched.select("doc_id", "k1", "k2").join(
        classes.select("k1", "k2", "class_id", "n_links", (F.col("n") - 1).alias("n_copies")), ["k1", "k2"]).select(
        "doc_id", "class_id", "n_links", "n_copies")


def keep_first(docs: DataFrame, options: JaccardOptions = JaccardOptions()) -> DataFrame:
    """One document of each class, the one with the smallest id; the columns stay as they were."""
    sketched = stage(sketches(docs, options), "sketches")
    classes = classes_of_units(docs, unit_table(sketched), options)
    rows = stage(sketched.select("doc_id", "k1", "k2").join(
        classes.select("k1", "k2", "class", "class_id"), ["k1", "k2"]).where(
        F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").agg(
        F.count("*").alias("n")).where("doc_id is not null"), "kept-ids")
    once = rows.where("n = 1").select(F.col("doc_id").alias("kept"))
    keys = docs["doc_id"].cast("long")
    # Merged at every size, so that the plan and its shuffles grow evenly.
    kept = docs.join(once.hint("merge"), keys == once["kept"], "left_semi")
    # Rows whose id is missing or comes up again among the kept ones are told apart by their words.
    shared = rows.where("n > 1").select(F.col("doc_id").alias("kept"))
    if shared.isEmpty() and sketched.where("doc_id is null").isEmpty():
        return kept
    odd = docs.where(keys.isNull()).unionByName(docs.join(shared, keys == shared["kept"], "left_semi"))
    return kept.unionByName(_first_of_classes(odd, classes, options))


def _first_of_classes(docs: DataFrame, classes: DataFrame, options: JaccardOptions) -> DataFrame:
    """One row of each class, of those rows whose id is the class's."""
    own, n = docs.columns, options.n
    numbered = stage(docs.select(F.struct(*[docs[c] for c in own]).alias("row"),
                                 F.monotonically_increasing_id().alias("number")), "odd-rows")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            k1, k2 = _text_keys(*word_hashes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(k1), pa.array(k2)], ["number", "k1", "k2"])

    keyed = numbered.select("number", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(
        key, "number long, k1 long, k2 long")
    ids = numbered.select("number", F.col("row.doc_id").cast("long").alias("doc_id"))
    firsts = keyed.join(ids, "number").join(classes.select("k1", "k2", "class", "class_id"), ["k1", "k2"]).where(
        F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("number").alias("number"))
    return numbered.join(firsts, "number", "left_semi").select("row.*")
