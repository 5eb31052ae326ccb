"""An index that grows and shrinks without being rebuilt.

The store is a row of segments, each committed as a whole (see ``sources.commits``): a base, then
deltas. A delta holds the passages, terms and vectors of the documents that were added or
changed, a tombstone for every document that was changed or removed, and what the change adds
to and takes from the document frequencies, the number of passages and their total length.
A row counts if no later segment has a tombstone of its document; the statistics are
sums over the segments. Splitting, counting and hashing are done for changed documents only.

Passages, terms and vectors are one table, ``rows``, written in the pass that splits and counts;
the statistics are taken from what was written. Compaction writes the rows that count as a new base. Readers start from the last base.
A segment that is written again under its number replaces itself: it is worked out from the
segments before it. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from groundsieve.config import HASH_DIMS, RetrievalConfig
from groundsieve.operators.lexical import LexicalIndex, mean_idf
from groundsieve.plans.ingest import CorpusIndex, indexed_passages, ingest, passages_of, terms_of, vectors_of
from groundsieve.sources import commits
from groundsieve.sources.commits import committed, read_attempt, stored_table, write_attempt
from groundsieve.sources.staging import bounded, sent, stage

_KEY = "segment"
_COPIES = "copies"


def create_segments(documents: DataFrame, path: str, config: RetrievalConfig = RetrievalConfig(),
                    dims: int = HASH_DIMS) -> None:
    """Starts a store with the index of documents(document_id, text, strategies)."""
    _write(path, _name(1, "base"), _rows(documents, config, dims), _tombstones(documents).limit(0))


def update_segments(path: str, changed: DataFrame, removed: DataFrame | None = None, number: int | None = None,
                    config: RetrievalConfig = RetrievalConfig(), dims: int = HASH_DIMS) -> int:
    """Adds or replaces ``changed`` documents and takes out those of ``removed``(document_id);
    returns the number of the new segment. With ``number`` that segment is written again."""
    spark = changed.sparkSession
    number = number or _number(segments(spark, path)[-1]) + 1
    gone = _tombstones(changed)
    if removed is not None:
        gone = gone.union(_tombstones(removed)).distinct()
    gone = stage(gone, "tombstones")
    before = _live(spark, path, "passage_terms", number).join(_sent(gone), "document_id", "left_semi")
    before = stage(before.select("length", "entries"), "replaced")
    _write(path, _name(number, "delta"), _rows(changed, config, dims), gone, before)
    return number


def compact_segments(spark: SparkSession, path: str) -> None:
    """Writes all rows that count as a new base."""
    last = segments(spark, path)[-1]
    rows, name = _live(spark, path, "rows").drop(_KEY), _name(_number(last) + 1, "base")
    tables = {"rows": rows, "tombstones": rows.select("document_id").limit(0),
              "sizes": _summed_sizes(_read(spark, path, "sizes")),
              "frequencies": _summed_frequencies(_read(spark, path, "frequencies"))}
    commits.write_run(tables, path, name, _KEY)


def open_segments(spark: SparkSession, path: str, dims: int = HASH_DIMS) -> CorpusIndex:
    """The index of the documents as they are now, equal to one built from them afresh."""
    passages, terms, vectors = (_live(spark, path, t).drop(_KEY) for t in ("passages", "passage_terms", "vectors"))
    # One row a term, read several times by every search.
    stats = stage(_summed_frequencies(_read(spark, path, "frequencies")).where("df > 0"), "term_stats")
    sizes = _read(spark, path, "sizes").agg(
        F.coalesce(F.sum("n_passages"), F.lit(0)).alias("n_passages"), F.sum("total_length").alias("total_length"))
    sizes = sizes.select("n_passages", (F.col("total_length") / F.nullif("n_passages", F.lit(0))).alias("mean_length"))
    return CorpusIndex(passages, LexicalIndex(
        terms.drop("document_id"), stats, mean_idf(sizes, stats)), vectors.drop("document_id"), True, dims)


def segments(spark: SparkSession, path: str) -> list[str]:
    """The names of the segments from the last base on, in order; one for each change."""
    names = sorted(r[0] for r in committed(spark, path).select("run").distinct().collect())
    start = max(i for i, n in enumerate(names) if n.endswith("base"))
    return names[start:]


def _name(number: int, kind: str) -> str:
    return f"{number:010d}-{kind}"


def _number(name: str) -> int:
    return int(name.split("-")[0])


def _rows(documents: DataFrame, config: RetrievalConfig, dims: int) -> DataFrame:
    """Indexed passages of documents. ``copies`` tells how many rows bear the id of the passage, as terms
    and vectors stand once for each of them: one, but for documents that come more than once, and
    none without an id."""
    def indexed(some: DataFrame) -> DataFrame:
        return indexed_passages(ingest(some, config).passages, config.compat, dims)

    # A key of its own: Spark would ask the conditions of the documents of the repeated ids too, casts that fail there included.
    key = F.concat(F.lit("="), F.col("document_id").cast("string")).alias("repeated_key")
    again = documents.groupBy(key).count().where("repeated_key is not null and count > 1").select("repeated_key")
    again = stage(again, "repeated")
    one = F.when(F.col("passage_id").isNotNull(), 1).otherwise(0).cast("long")
    if again.isEmpty():
        return indexed(documents).withColumn(_COPIES, one)
    keyed, repeated = documents.withColumn("repeated_key", key), sent(again)
    rows = indexed(keyed.join(repeated, "repeated_key", "left_anti").drop("repeated_key")).withColumn(_COPIES, one)
    more = indexed(keyed.join(repeated, "repeated_key", "left_semi").drop("repeated_key"))
    return rows.unionByName(more.withColumn(_COPIES, F.count("*").over(W.partitionBy("passage_id"))))


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows as often as their passage id stands in their segment."""
    each = F.explode(F.array_repeat(F.lit(0), F.col(_COPIES).cast("int")))
    return rows.withColumn(_COPIES, each).drop(_COPIES)


def _tombstones(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("document_id").cast("string").alias("document_id")).distinct()


def _summed_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum("n_passages").alias("n_passages"), F.sum("total_length").alias("total_length"))


def _summed_frequencies(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("term").agg(F.sum("df").alias("df"))


def _write(path: str, name: str, rows: DataFrame, gone: DataFrame, before: DataFrame | None = None) -> None:
    """Writes and commits a segment: its rows, then what they add to the statistics and what the rows
    ``before`` them (length, entries) take away."""
    attempt = write_attempt({"rows": rows}, path, name, _KEY)
    held = _terms(read_attempt(rows, path, "rows", name, attempt, _KEY))
    terms = held.select(F.lit(1).alias("sign"), "length", "entries")
    if before is not None:
        terms = terms.union(before.select(F.lit(-1), "length", "entries"))
    sizes = terms.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n_passages"),
                      F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("total_length"))
    change = terms.select(F.col("sign").cast("long").alias("df"), F.explode("entries.term").alias("term"))
    others = {"tombstones": gone, "sizes": sizes, "frequencies": _summed_frequencies(change).where("df <> 0")}
    write_attempt(others, path, name, _KEY, attempt=attempt)
    commits.commit(path, name, attempt, {"rows": rows} | others, _KEY)


def _terms(rows: DataFrame) -> DataFrame:
    """passage_id, length, entries and document_id (and the segment) of stored rows."""
    keys = [c for c in ("document_id", _KEY) if c in rows.columns]
    return _repeated(terms_of(rows, *keys, _COPIES))


def _vectors(rows: DataFrame) -> DataFrame:
    return _repeated(vectors_of(rows, "document_id", _KEY, _COPIES))


_VIEWS = {"rows": lambda rows: rows, "passages": lambda rows: passages_of(rows.drop(_COPIES)),
          "passage_terms": _terms, "vectors": _vectors}


def _read(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame:
    """The rows of a table in the segments that count, in those before a number if given."""
    names = [n for n in segments(spark, path) if before is None or _number(n) < before]
    chosen = committed(spark, path).where((F.col("table") == table) & F.col("run").isin(names)).select(
        F.col("run").alias(_KEY), "attempt")
    rows = stored_table(spark, path, table, _KEY).where(F.col(_KEY).isin(names))
    return rows.join(F.broadcast(chosen), [_KEY, "attempt"]).drop("attempt")  # one row for each segment


def _live(spark: SparkSession, path: str, view: str, before: int | None = None) -> DataFrame:
    """Rows whose document has no tombstone in a later segment, or what is read from them as ``view``."""
    killed = _read(spark, path, "tombstones", before).groupBy("document_id").agg(F.max(_KEY).alias("killed_by"))
    rows = _VIEWS[view](_read(spark, path, "rows", before)).join(_sent(killed), "document_id", "left")
    return rows.where(F.col("killed_by").isNull() | (F.col(_KEY) >= F.col("killed_by"))).drop("killed_by")


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if bounded(rows) else rows

