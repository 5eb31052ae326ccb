"""A posting store: BM25 lists on disk by term, in blocks whose largest part of a score is known.

Passages in the order of their ids are cut into ranges of 1,024. A block holds the
postings of a term in one range: slots within the range and the parts of the score
that they give (tf / (tf + damping), before the weight of the term). Blocks are written by
buckets of the term's hash, sorted by term, so a search opens the files of the
terms it asks for. A frequent term has a block in every range and is spread over many tasks.

A search first adds up, from the blocks' largest parts alone, what a range can give a
query at most. The most promising ranges of each query are scored; the k-th score found there
is the bar, and of the other ranges only those are scored that can reach it. Every passage
lies in one range, so the result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.config import BM25_B, BM25_K1, SCORE_DIGITS
from groundsieve.functions import rangescan
from groundsieve.operators.lexical import LexicalIndex, query_weights
from groundsieve.operators.topk import best
from groundsieve.sources.staging import bounded, stage

# The kernel travels with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(rangescan)

RANGE = 1024
BUCKETS = 256
SEEDS = 4             # ranges of a query that are scored first
QUERIES = 2048        # queries of a block; a task holds the scores of so many over one range
_BLOCK = "term:string,n:int,largest:double,slots:array<smallint>,parts:array<double>"
_HITS = "query_id string, range long, slot int, score double"
# Scores are rounded before they are compared, so a range counts if it comes this close to the bar.
_SLACK = 10.0 ** -SCORE_DIGITS


@dataclass(frozen=True)
class PostingStore:
    """blocks(bucket, term, range, n, largest, slots, parts), ranges(range, passage_ids by slot),
    and the statistics that weight a query's terms."""

    blocks: DataFrame
    ranges: DataFrame
    index: LexicalIndex


@dataclass(frozen=True)
class BlockSearch:
    """The hits, and per query how much was looked at: n_ranges and n_blocks that hold one of its
    terms, n_ranges_read and n_blocks_read of them that were scored."""

    hits: DataFrame
    report: DataFrame


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def posting_tables(index: LexicalIndex, buckets: int = BUCKETS, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Blocks and ranges of a lexical index; ``size`` is a power of two."""
    if size & (size - 1) or not 0 < size <= 32_768:
        raise ValueError("a range has a power of two of passages, 32,768 at most")
    mean_length = index.corpus_stats.select("mean_length").scalar()
    damping = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / mean_length)
    kind = index.passage_terms.schema["passage_id"].dataType.simpleString()
    # Numbers of passages in the order of their ids: the part of the order in the high bits, the
    # place within it in the low ones. A range lies in one part, in a run, so its blocks are made where
    # its passages were sorted. Written down, as the numbers come from where a row stands.
    placed = stage(
        index.passage_terms.select("passage_id", damping.alias("damping"), F.col("entries.term").alias("terms"),
                                   F.col("entries.tf").alias("tf"))
        .repartitionByRange("passage_id").sortWithinPartitions("passage_id")
        .select(F.floor(F.monotonically_increasing_id() / size).alias("range"), "passage_id", "damping", "terms", "tf")
        .mapInArrow(rangescan.blocks_of_ranges, f"range long, passage_ids array<{kind}>, blocks array<struct<{_BLOCK}>>"),
        "placed_passages")
    ranges = placed.select("range", "passage_ids")
    blocks = placed.select("range", F.inline("blocks")).select(
        _bucket(F.col("term"), buckets).alias("bucket"), "term", "range", "n", "largest", "slots", "parts")
    return blocks, ranges


def write_postings(index: LexicalIndex, path: str, buckets: int = BUCKETS, size: int = RANGE) -> None:
    """Writes the store of an index to a new folder."""
    blocks, ranges = posting_tables(index, buckets, size)
    ranges.write.parquet(f"{path}/ranges")
    # What the postings of a block tell is not moved with them.
    moved = blocks.drop("n", "largest").repartitionByRange("bucket", "term", "range").sortWithinPartitions(
        "bucket", "term", "range")
    moved.select("term", "range", F.size("slots").alias("n"), F.array_max("parts").alias("largest"), "slots", "parts",
                 "bucket").write.partitionBy("bucket").parquet(f"{path}/blocks")
    index.term_stats.write.parquet(f"{path}/term_stats")
    sizes = index.corpus_stats.withColumns({"buckets": F.lit(buckets), "range_size": F.lit(size)})
    sizes.write.parquet(f"{path}/corpus_stats")  # the last one: without it there is no store


def read_postings(spark: SparkSession, path: str) -> PostingStore:
    stats = spark.read.parquet(f"{path}/corpus_stats")
    terms = spark.read.parquet(f"{path}/term_stats")
    blocks = spark.read.schema(
        "term string, range long, n int, largest double, slots array<smallint>, parts array<double>, bucket int"
    ).parquet(f"{path}/blocks")
    return PostingStore(blocks, spark.read.parquet(f"{path}/ranges"), LexicalIndex(None, terms, stats))


def asked_blocks(store: PostingStore, weights: DataFrame) -> DataFrame:
    """The blocks of the asked terms. Their buckets, a bounded number, go into the filter of the
    scan, and so do the terms if they are few."""
    sizes = store.index.corpus_stats.first()
    terms = weights.select("term").distinct()
    asked = [r[0] for r in terms.select(_bucket(F.col("term"), sizes["buckets"])).distinct().collect()]
    blocks = store.blocks.where(F.col("bucket").isin(asked))
    few = terms.limit(513).collect()
    if len(few) <= 512:
        return blocks.where(F.col("term").isin([r[0] for r in few]))
    return blocks.join(F.broadcast(terms) if bounded(terms) else terms, "term", "left_semi")


def block_search(store: PostingStore, queries: DataFrame, k: int, seeds: int = SEEDS,
                 queries_at_once: int = QUERIES) -> BlockSearch:
    """The k best passages per query(query_id, search_terms), as ``bm25_search`` gives them:
    query_id, passage_id, lexical_score, rank_lexical."""
    weights = stage(query_weights(store.index, queries).select(
        F.col("query_id").cast("string").alias("query_id"), "term", "weight"), "query_weights")
    blocks = asked_blocks(store, weights)
    size = store.index.corpus_stats.first()["range_size"]
    query_blocks = max(1, -(-queries.count() // queries_at_once))
    most = F.greatest("weight", F.lit(0.0)) * F.col("largest")
    # From here on only names of blocks and numbers move, until a range is to be scored.
    reach = stage(blocks.select("term", "range", "largest").join(_sent(weights), "term").groupBy(
        "query_id", "range").agg(F.sum(most).alias("reach"), F.count("*").alias("n_blocks")), "range_reach")

    asked = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("asked"))
    part = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("part_of_queries")

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        return rangescan.best_of_range(left, right, k, SCORE_DIGITS, size)

    def scored(pairs: DataFrame) -> DataFrame:
        # A block goes to the queries of its range as it is, a query there with all of its terms.
        wanted = pairs.select("range", part).distinct()
        held = blocks.select("term", "range", "slots", "parts").join(_sent(wanted), "range")
        asking = pairs.select("query_id", "range", part).join(_sent(asked), "query_id")
        return held.groupBy("range", "part_of_queries").cogroup(
            asking.groupBy("range", "part_of_queries")).applyInArrow(kernel, _HITS)

    order = F.desc("score"), F.asc("range"), F.asc("slot")
    first = stage(best(reach.where("reach > 0"), "place", seeds, F.desc("reach"), F.asc("range")), "seed_ranges")
    early = stage(best(scored(first.select("query_id", "range")), "place", k, *order), "seed_hits")
    bar = early.where(F.col("place") == k - 1).select("query_id", F.col("score").alias("bar"))
    others = reach.where("reach > 0").join(first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(
        _sent(bar), "query_id", "left").where(F.col("reach") >= F.coalesce("bar", F.lit(0.0)) - _SLACK)
    others = stage(others.select("query_id", "range", "n_blocks"), "other_ranges")
    late = best(scored(others.select("query_id", "range")), "place", k, *order)
    both = stage(best(early.drop("place").unionByName(late.drop("place")), "rank_lexical", k, *order), "block_hits")
    # Only hits look up their passages: slots of a few ranges.
    named = store.ranges.join(_sent(both), "range").select(
        "query_id", F.get("passage_ids", F.col("slot")).alias("passage_id"),
        F.col("score").alias("lexical_score"), "rank_lexical")
    read = first.select("query_id", "n_blocks").unionByName(others.select("query_id", "n_blocks")).groupBy("query_id").agg(
        F.count("*").alias("n_ranges_read"), F.sum("n_blocks").alias("n_blocks_read"))
    report = reach.groupBy("query_id").agg(
        F.count("*").alias("n_ranges"), F.sum("n_blocks").alias("n_blocks")).join(read, "query_id", "left")
    return BlockSearch(named, report.fillna(0))


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if bounded(rows) else rows
