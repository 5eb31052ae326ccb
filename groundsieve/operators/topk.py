"""Ranks and cuts within a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranked(rows: DataFrame, rank: str, *order: Column, by: tuple = ("query_id",)) -> DataFrame:
    """Adds a 0-based rank within each query."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn(rank, place)


def best(rows: DataFrame, rank: str, k: int, *order: Column, by: tuple = ("query_id",)) -> DataFrame:
    """The first k rows of each query. Spark cuts to k before the shuffle as
    well, so a query ships at most k rows per task."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn(rank, place).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)
