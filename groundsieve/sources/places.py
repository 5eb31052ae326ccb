"""Passages stored by neighbourhood, so that a window is read where it lies.

A neighbourhood is a run of 64 places of a document. Passages are written into buckets by
their neighbourhood and sorted in it, so a document that holds a third of all rows is spread
over all buckets; a second, narrow table tells the place of a passage and is bucketed by its
id. Joins on these keys read a bucket against a bucket and do not shuffle the stored side.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.sources.staging import new_folder

SIZE = 64
BUCKETS = 64


@dataclass(frozen=True)
class PassagePlaces:
    """places(passage_id, document_id, passage_index, text, section_title, section_order) and
    passages(neighbourhood, passage_index, passage_id, text); ``size`` places in a neighbourhood."""

    places: DataFrame
    passages: DataFrame
    size: int


def neighbourhood(document_id: Column, block: Column) -> Column:
    """One string for a document and a block of its places; the number behind the last sign is the block."""
    return F.concat(document_id, F.lit("#"), block.cast("string"))


def store_places(passages: DataFrame, name: str = "passages", path: str | None = None,
                 buckets: int = BUCKETS, size: int = SIZE) -> PassagePlaces:
    """Writes both tables below ``path`` (by default a fresh place in the shared folder) and
    enters them in the catalog of the session under fresh names."""
    spark = passages.sparkSession
    path, tag = path or new_folder(spark, name), uuid.uuid4().hex
    columns = ["passage_id", "document_id", "passage_index", "text", "section_title", "section_order"]
    _bucketed(passages.select(*columns), f"{path}/places", f"places_{tag}", buckets, "passage_id")
    block = F.floor(F.col("passage_index") / size)
    _bucketed(passages.select(neighbourhood(F.col("document_id"), block).alias("neighbourhood"), "passage_index",
                              "passage_id", "text"), f"{path}/passages", f"passages_{tag}", buckets,
              "neighbourhood", "passage_index")
    return PassagePlaces(spark.table(f"places_{tag}"), spark.table(f"passages_{tag}"), size)


def _bucketed(rows: DataFrame, path: str, table: str, buckets: int, key: str, *order: str) -> None:
    # Dealt out as the buckets are, so that each bucket is one file.
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)

