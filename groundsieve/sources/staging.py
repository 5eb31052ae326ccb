"""Written intermediate tables, and size checks that decide how to join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A broadcast side may hold this many rows at most (tens of MB); see ``bounded``.
BROADCAST_ROWS = 1_000_000
_SMALL_SPLIT = 64 * 1024 * 1024
_own_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local
    session without one gets a temporary folder of its own."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="groundsieve-")
    return _own_folder.name


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    This cuts the lineage at a table that outlives lost executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if the table has at most ``rows`` rows; reads no more than it needs to know."""
    return df.limit(rows + 1).count() <= rows


def sent(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join that goes to every task if it has at most ``rows`` rows."""
    return F.broadcast(df) if bounded(df, rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads an input that arrives in few splits over all cores: a small one, and one whose rows lie in
    fewer row groups than there are cores, whatever its size.

    Inputs with plenty of data per core are left as they were read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * _SMALL_SPLIT:
        return df.repartition(cores, *keys)
    return df.repartition(max(cores, size // _SMALL_SPLIT), *keys) if _uneven(df, cores) else df


def _uneven(df: DataFrame, cores: int) -> bool:
    """True if one split holds more than twice a core's share of the rows; reads the files' row counts only."""
    splits = df.select(F.spark_partition_id().alias("split")).groupBy("split").count()
    most, rows = splits.agg(F.max("count"), F.sum("count")).first()
    return most is not None and most * cores > 2 * rows
