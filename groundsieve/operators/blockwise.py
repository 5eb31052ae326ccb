"""Exact top-k of many queries over many passages without a row per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from groundsieve.functions import nearest
from groundsieve.operators.topk import best

# The kernels travel with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(nearest)

# Queries that go to every task at once; more are searched block by block.
LOCAL_QUERIES = 4096
SALTS = 32
LOCAL_DETAILS = 500_000
CELL_PASSAGES = 50_000
_OUT = "query_id string, passage_id string, score double"


def block_search(
    passages: DataFrame, queries: DataFrame, details: DataFrame | None, scan_of: Callable,
    k: int, score: str, rank: str,
    local_queries: int = LOCAL_QUERIES, cell_passages: int = CELL_PASSAGES,
    local_details: int = LOCAL_DETAILS,
) -> DataFrame:
    """query_id, passage_id, ``score`` and 0-based ``rank`` of the k best passages per query.

    ``queries`` has one row per query_id; ``details`` (by default the same
    table) holds what ``scan_of(details table, query ids)`` needs to build the
    kernel. Up to ``local_queries`` queries with ``local_details`` rows travel
    with the task and the passages are scanned where they lie, without a
    shuffle; no more than that is ever fetched. A larger table is cut into a
    grid of query blocks and passage cells of bounded size by the hashes of the
    ids, one task per cell. Either way a task emits at most k rows per query,
    and the final cut sees nothing else.
    """
    passages = passages.withColumn("passage_id", F.col("passage_id").cast("string"))
    ids = queries.select(F.col("query_id").cast("string"))
    details = (queries if details is None else details).withColumn(
        "query_id", F.col("query_id").cast("string"))
    head = ids.limit(local_queries + 1).toArrow()
    table = details.limit(local_details + 1).toArrow() if head.num_rows <= local_queries else None
    if table is not None and table.num_rows <= local_details:
        names = sorted(head.column("query_id").to_pylist())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = scan_of(table, names)
            for batch in batches:
                kernel.add(batch)
            yield from kernel.best.table().to_batches()

        partial = passages.mapInArrow(scan, _OUT)
    else:
        blocks = max(-(-ids.count() // local_queries), -(-details.count() // local_details))
        cells = max(1, -(-passages.count() // cell_passages))

        def numbers(n: int):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        def numbered(column: str, n: int):
            return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            kernel = scan_of(left, sorted(set(left.column("query_id").to_pylist())))
            if left.num_rows and right.num_rows:
                kernel.add(right)
            return kernel.best.table()

        # Queries without details (no known term) still take part: a kernel
        # may owe them zero-score passages.
        asked = ids.join(details, "query_id", "left").withColumn(
            "block", numbered("query_id", blocks)).withColumn("cell", numbers(cells))
        held = passages.withColumn("cell", numbered("passage_id", cells)).withColumn(
            "block", numbers(blocks))
        partial = asked.groupBy("block", "cell").cogroup(
            held.groupBy("block", "cell")).applyInArrow(cell, _OUT)
    order = F.desc(score), F.asc("passage_id")
    # Cut by query and salt first: a query's hits from all tasks never meet in one task.
    salted = best(partial.withColumnRenamed("score", score).withColumn(
        "salt", F.pmod(F.xxhash64("passage_id"), F.lit(SALTS))), rank, k, *order, by=("query_id", "salt"))
    return best(salted.drop("salt", rank), rank, k, *order)
