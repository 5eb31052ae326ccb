"""Tables that are written exactly once: what a run has written counts when its commit is there.

A run (a project, a label, a batch of questions) writes each of its tables to a partition
of its own, ``<table>/<key>=<run>/attempt=<fresh name>``, and then one row to ``commits``.
That row is one file, which Spark puts in place whole or not at all. Readers see
the attempts that the commits name: of several for a run the latest, so a run that
is tried again replaces what it wrote before, all tables at once, and one that
was killed on the way leaves nothing that is read.

The commit also declares the columns of each table. The partition columns are strings: left to
inference, the runs ``1``, ``01`` and ``1.0`` would be one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from groundsieve.sources.staging import bounded

_TABLES = "array<struct<name:string,schema:string>>"
_COMMITS = f"run string, attempt string, tables {_TABLES}, committed_at timestamp"


def write_attempt(tables: dict[str, DataFrame], path: str, run: str, key: str = "run",
                  form: str = "parquet", attempt: str | None = None) -> str:
    """Writes the tables of a run and returns the name of the attempt, a fresh one unless tables
    are added to one; nothing counts yet."""
    if not run:
        raise ValueError("a run needs a name")
    attempt = attempt or f"a{uuid.uuid4().hex}"
    for name, rows in tables.items():
        marked = rows.drop(key, "attempt").withColumns({key: F.lit(run), "attempt": F.lit(attempt)})
        marked.write.mode("append").partitionBy(key, "attempt").format(form).save(f"{path}/{name}")
    return attempt


def write_runs(rows: DataFrame, path: str, name: str, key: str) -> str:
    """Writes and commits the rows of many runs in one job; the column ``key`` names the run of each.
    Runs that have no row here stay as they are. A row without a run is an error."""
    attempt = f"a{uuid.uuid4().hex}"
    run = F.col(key).cast("string")
    named = F.when(F.length(run) > 0, run).otherwise(F.raise_error(F.lit("a run needs a name")))
    marked = rows.drop("attempt").withColumns({key: named, "attempt": F.lit(attempt)})
    marked.write.mode("append").partitionBy(key, "attempt").parquet(f"{path}/{name}")
    schema = rows.drop(key, "attempt").schema.json()
    tables = F.array(F.struct(F.lit(name).alias("name"), F.lit(schema).alias("schema")))
    rows.select(run.alias("run")).distinct().select(
        "run", F.lit(attempt).alias("attempt"), tables.alias("tables"), F.current_timestamp().alias("committed_at"),
    ).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return attempt


def read_attempt(rows: DataFrame, path: str, name: str, run: str, attempt: str, key: str = "run",
                 form: str = "parquet") -> DataFrame:
    """A table of an attempt that was written from ``rows`` and need not count yet."""
    fields = [StructField(f.name, f.dataType) for f in rows.drop(key, "attempt").schema]
    partitions = [StructField(c, StringType()) for c in (key, "attempt")]
    stored = rows.sparkSession.read.schema(StructType([*fields, *partitions])).format(form).load(f"{path}/{name}")
    return stored.where((F.col(key) == run) & (F.col("attempt") == attempt)).drop(key, "attempt")


def commit(path: str, run: str, attempt: str, tables: dict[str, DataFrame], key: str = "run") -> None:
    """Makes an attempt count. Committing it again changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    schemas = [(name, rows.drop(key, "attempt").schema.json()) for name, rows in sorted(tables.items())]
    row = spark.createDataFrame([(run, attempt, schemas)], f"run string, attempt string, tables {_TABLES}")
    row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
        f"{path}/commits")


def write_run(tables: dict[str, DataFrame], path: str, run: str, key: str = "run",
              form: str = "parquet") -> str:
    """Writes and commits the tables of a run; returns the name of the attempt."""
    attempt = write_attempt(tables, path, run, key, form)
    commit(path, run, attempt, tables, key)
    return attempt


def committed(spark: SparkSession, path: str) -> DataFrame:
    """run, table, committed_at, attempt and schema: of each run and table the attempt that counts."""
    rows = spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    # What was committed before this read began. As a comparison it also tells Spark that the
    # list is selective, so the partitions of a table are pruned by it.
    rows = rows.where(F.col("committed_at") <= F.current_timestamp()).select(
        "run", "attempt", "committed_at", F.inline("tables")).withColumnRenamed("name", "table")
    newest = F.max(F.struct("committed_at", "attempt", "schema"))
    return rows.groupBy("run", "table").agg(newest.alias("last")).select("run", "table", "last.*")


def stored_table(spark: SparkSession, path: str, name: str, key: str = "run", form: str = "parquet") -> DataFrame:
    """All rows of a table, also those that do not count, with the columns that its commits
    declare: fields of any of its runs, and ``key`` and attempt as strings."""
    fields: dict[str, StructField] = {}
    schemas = committed(spark, path).where(F.col("table") == name).groupBy("schema").agg(
        F.max("committed_at").alias("at")).orderBy("at").collect()  # one row for each form the table has had
    for row in schemas:
        fields |= {f.name: StructField(f.name, f.dataType) for f in StructType.fromJson(json.loads(row["schema"]))}
    partitions = [StructField(c, StringType()) for c in (key, "attempt")]
    return spark.read.schema(StructType([*fields.values(), *partitions])).format(form).load(f"{path}/{name}")


def read_runs(spark: SparkSession, path: str, name: str, run: str | None = None, key: str = "run",
              runs: DataFrame | None = None, form: str = "parquet") -> DataFrame:
    """The committed rows of a table: of one run, of those in the only column of ``runs``, or of all.

    The list of commits is one row for each run; it travels to the scan, which opens only
    the partitions that it names.
    """
    chosen = committed(spark, path).where(F.col("table") == name).select(F.col("run").alias(key), "attempt")
    rows = stored_table(spark, path, name, key, form)
    if run is not None:
        chosen, rows = chosen.where(F.col(key) == run), rows.where(F.col(key) == run)
    if runs is not None:
        (column,) = runs.columns
        chosen = chosen.join(runs.select(F.col(column).cast("string").alias(key)).distinct(), key)
    if bounded(chosen):
        chosen = F.broadcast(chosen)
    return rows.join(chosen, [key, "attempt"]).drop("attempt")


def lost_attempts(spark: SparkSession, path: str, name: str, key: str = "run") -> DataFrame:
    """run and attempt of partitions that no reader sees: replaced or never committed."""
    there = stored_table(spark, path, name, key).select(key, "attempt").distinct()
    counting = committed(spark, path).where(F.col("table") == name).select(F.col("run").alias(key), "attempt")
    return there.join(counting, [key, "attempt"], "left_anti")
