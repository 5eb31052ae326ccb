"""Inverted-file vector index: vectors stored by coarse cells, cells pruned by an angle bound.

Centres of the cells are fitted on a bounded sample (``sample`` vectors at most); every
vector is then stored in the cell of its nearest centre with its angle to it. For each cell the
smallest and the largest of these angles are known, and with them the largest cosine that any
of its vectors can have with a query.

A search scores the ``probes`` cells of each query whose centres are nearest. In the exact mode the
k-th score found there is the bar, and every other cell that can reach it is scored too,
so the result is that of comparing everything. Without it the search ends there;
``probes_for`` tells how many cells that takes for a recall, which depends on how well
the vectors fall into cells.

A cell may hold a third of all vectors (copies): cells are cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.config import SCORE_DIGITS
from groundsieve.functions import cells as kernels, nearest
from groundsieve.operators.dense import broken_vectors, checked_length
from groundsieve.operators.topk import best
from groundsieve.sources.staging import bounded, stage

# The kernels travel with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(nearest)

SAMPLE = 20_000
MOST_CELLS = 4096
PART = 8192      # vectors of a cell that one task compares
QUERIES = 1024   # queries that it compares them with
PROBES = 8
_SLACK = 2 * 10.0 ** -SCORE_DIGITS  # scores are rounded before they are compared
_HITS = "query_id string, passage_id string, score double"


@dataclass(frozen=True)
class CellIndex:
    """vectors(cell, part, passage_id, vector, angle) and cells(cell, n, parts, near, far,
    centre); ``dims`` numbers in a vector."""

    vectors: DataFrame
    cells: DataFrame
    dims: int


@dataclass(frozen=True)
class CellSearch:
    """The hits, and per query the number of cells there are and of those scored."""

    hits: DataFrame
    report: DataFrame


def sample_centres(vectors: DataFrame, dims: int, cells: int | None, sample: int = SAMPLE) -> np.ndarray:
    """Centres fitted on at most ``sample`` vectors, those with the smallest hashes of their ids.
    Without ``cells`` there are about as many as a cell has vectors."""
    n = vectors.count()
    spot = F.shiftrightunsigned(F.xxhash64("passage_id"), 2)
    # Twice the share first, then cut: few rows are sorted, and never more than ``sample`` stay.
    share = int(min(1.0, 2 * sample / max(n, 1)) * 2**62)
    chosen = vectors.where(spot <= F.lit(share)).orderBy(spot, "passage_id").limit(sample)
    rows = kernels.matrix(chosen.select("vector").toArrow().column("vector"), dims)
    return kernels.fit_centres(rows, cells or int(min(MOST_CELLS, max(1, round(n ** 0.5)))))


def build_cells(vectors: DataFrame, dims: int, cells: int | None = None, sample: int = SAMPLE,
                part: int = PART) -> CellIndex:
    """Index of vectors(passage_id, vector); vectors that can be no hits are left out
    (``broken_vectors`` lists them), one of another length is an error."""
    rows = vectors.select(F.col("passage_id").cast("string").alias("passage_id"), F.col("vector").cast("array<double>"))
    sound = checked_length(rows.where(F.col("vector").isNotNull()), "passage_id", dims).where(
        ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    centres = sample_centres(sound, dims, cells, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = kernels.nearest_cells(kernels.matrix(batch.column("vector"), dims), centres)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), batch.column("passage_id"), batch.column("vector"), pa.array(angle)],
                ["cell", "passage_id", "vector", "angle"])

    placed = sound.mapInArrow(place, "cell int, passage_id string, vector array<double>, angle double")
    held = stage(placed, "placed_vectors")
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    listed = held.sparkSession.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)] + [(kernels.ZERO, [0.0] * dims)], "cell int, centre array<double>")
    known = stage(sizes.join(listed, "cell").withColumn("parts", F.ceil(F.col("n") / part).cast("int")), "cells")
    # One row for each cell, MOST_CELLS at most.
    spread = held.join(F.broadcast(known.select("cell", "parts")), "cell").withColumn(
        "part", F.pmod(F.xxhash64("passage_id"), F.col("parts")).cast("int")).drop("parts")
    return CellIndex(spread, known, dims)


def write_cells(index: CellIndex, path: str) -> None:
    """Writes the index to a new folder, vectors by cell; the small table comes last."""
    index.vectors.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(
        f"{path}/vectors")
    index.cells.withColumn("dims", F.lit(index.dims)).write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    cells = spark.read.parquet(f"{path}/cells")
    vectors = spark.read.schema(
        "passage_id string, vector array<double>, angle double, part int, cell int").parquet(f"{path}/vectors")
    dims = cells.select("dims").first()
    return CellIndex(vectors, cells.drop("dims"), dims[0] if dims else 0)


def _nearest_first() -> tuple[Column, Column]:
    return F.desc("cosine"), F.asc("cell")


def query_bounds(index: CellIndex, queries: DataFrame) -> DataFrame:
    """query_id, cell, its cosine with the query, and the largest one that a vector of it can have."""
    table = index.cells.orderBy("cell").toArrow()  # MOST_CELLS rows at most
    names = table.column("cell").to_numpy()
    dims = index.dims
    centres = kernels.matrix(table.column("centre"), dims)
    near, far = (table.column(c).to_numpy() for c in ("near", "far"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                cosines, bounds = kernels.cell_bounds(kernels.matrix(rows.column("vector"), dims), centres, near, far)
                bounds[:, names == kernels.ZERO] = 0.0  # their cosine is 0 with everything
                yield pa.RecordBatch.from_arrays(
                    [rows.column("query_id").take(pa.array(np.repeat(np.arange(rows.num_rows), len(names)))),
                     pa.array(np.tile(names, rows.num_rows)), pa.array(cosines.ravel()), pa.array(bounds.ravel())],
                    ["query_id", "cell", "cosine", "bound"])

    return queries.mapInArrow(bound, "query_id string, cell int, cosine double, bound double")


def probes_for(index: CellIndex, k: int, recall: float = 0.95, sample: int = 200) -> int:
    """How many cells the fast mode has to probe for a recall: where the exact hits of at most
    ``sample`` stored vectors lie in the order in which their cells would be probed."""
    spot = F.xxhash64("passage_id")
    asked = index.vectors.orderBy(spot, "passage_id").limit(sample).select(
        F.col("passage_id").alias("query_id"), "vector")
    asked = stage(asked, "calibration")
    order = best(query_bounds(index, asked), "place", MOST_CELLS + 1, *_nearest_first())
    hits = cell_search(index, asked, k).hits.join(F.broadcast(asked.select("query_id")), "query_id")
    cells = hits.join(index.vectors.select("passage_id", "cell"), "passage_id")
    places = cells.join(order, ["query_id", "cell"]).select(F.percentile("place", F.lit(recall)).alias("p")).first()
    return int(-(-(places["p"] or 0) // 1)) + 1


def cell_search(index: CellIndex, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True,
                queries_at_once: int = QUERIES) -> CellSearch:
    """The k nearest passages per query(query_id, vector) by cosine, as ``dense_search`` gives them:
    query_id, passage_id, dense_score, rank_dense."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>"))
    asked = asked.where(F.col("vector").isNotNull())
    asked = stage(checked_length(asked.join(
        broken_vectors(asked, "query_id"), "query_id", "left_anti"), "query_id", index.dims), "asked_vectors")
    blocks = max(1, -(-asked.count() // queries_at_once))
    bounds = stage(query_bounds(index, asked), "cell_bounds")
    parts = F.broadcast(index.cells.select("cell", "parts"))
    dims = index.dims

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "passage_id": pa.array([], pa.string()),
                             "score": pa.array([], pa.float64())})
        scan = nearest.CosineScan(left, k, SCORE_DIGITS, dims, hashed=False)
        if right.num_rows:
            scan.add(right.combine_chunks())
        return scan.best.table()

    def scored(pairs: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        asking = pairs.join(asked, "query_id").join(parts, "cell").select(
            "query_id", "vector", F.col("cell").alias("in_cell"), block.alias("in_block"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in_part"))
        # A cell's vectors go out once for each block of queries that asks for it.
        wanted = pairs.select("cell", block.alias("block")).distinct()
        held = index.vectors.join(F.broadcast(wanted) if bounded(wanted) else wanted, "cell")
        return asking.groupBy("in_cell", "in_part", "in_block").cogroup(
            held.groupBy("cell", "part", "block")).applyInArrow(compare, _HITS)

    order = F.desc("score"), F.asc("passage_id")
    first = stage(best(bounds, "place", probes, *_nearest_first()), "probed_cells")
    chosen = first.select("query_id", "cell")
    hits = best(scored(chosen), "place", k, *order)
    if exact:
        hits = stage(hits, "probed_hits")
        bar = hits.where(F.col("place") == k - 1).select("query_id", F.col("score").alias("bar"))
        rest = stage(bounds.join(chosen, ["query_id", "cell"], "left_anti").join(bar, "query_id", "left").where(
            F.col("bound") >= F.coalesce("bar", F.lit(-2.0)) - _SLACK).select("query_id", "cell"), "other_cells")
        late = best(scored(rest), "place", k, *order)
        hits = best(hits.drop("place").unionByName(late.drop("place")), "place", k, *order)
        chosen = chosen.unionByName(rest)
    report = bounds.groupBy("query_id").agg(F.count("*").alias("n_cells")).join(
        chosen.groupBy("query_id").agg(F.count("*").alias("n_cells_read")), "query_id", "left")
    return CellSearch(hits.select(
        "query_id", "passage_id", F.col("score").alias("dense_score"), F.col("place").alias("rank_dense")),
        report.fillna(0))
