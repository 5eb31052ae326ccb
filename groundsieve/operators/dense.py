"""Dense retrieval: vectors for passages and exact top-k by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundsieve.config import HASH_DIMS, SCORE_DIGITS
from groundsieve.functions.nearest import CosineScan
from groundsieve.functions.vectors import hash_codes, summed_codes
from groundsieve.operators.blockwise import CELL_PASSAGES, LOCAL_QUERIES, block_search


def build_hash_index(passages: DataFrame, dims: int = HASH_DIMS) -> DataFrame:
    """passage_id and the hashed tokens of normalized_text as ``vector``."""
    return passages.select(
        "passage_id", hash_codes(F.col("normalized_text"), dims).alias("vector"))


def hash_embedding(vectors: DataFrame, key: str = "passage_id") -> DataFrame:
    """The unit vectors of hashed tokens as rows: key, dim (from 0), weight; zeros are left out."""
    summed = vectors.select(key, summed_codes(F.col("vector")).alias("cells"))
    cells = summed.select(key, F.explode_outer("cells").alias("c")).where(F.col("c").isNotNull())
    return cells.select(key, F.col("c.dim").alias("dim"), F.col("c.weight").alias("weight"))


def embed_questions(queries: DataFrame, dims: int = HASH_DIMS) -> DataFrame:
    """query_id and the hashed tokens of the normalised question as ``vector``."""
    return queries.select("query_id", hash_codes(F.col("normalized_question"), dims).alias("vector"))


def checked_length(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """The rows as they are; reading one whose vector has not ``dims`` numbers fails."""
    message = F.concat(F.lit("vector of "), F.col(key).cast("string"), F.lit(" has "),
                       F.size("vector").cast("string"), F.lit(f" numbers, not {dims}"))
    return rows.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(
        F.raise_error(message)))


def broken_vectors(vectors: DataFrame, key: str = "passage_id") -> DataFrame:
    """The keys of plain vectors that can be no hits, and why."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (
        F.abs(x.cast("double")) == float("inf")))
    reason = F.when(F.col("vector").isNull(), "missing").when(bad, "not finite")
    return vectors.select(key, reason.alias("reason")).where("reason is not null")


def dense_search(
    vectors: DataFrame, queries: DataFrame, k: int, dims: int = HASH_DIMS, hashed: bool = True,
    local_queries: int = LOCAL_QUERIES, cell_passages: int = CELL_PASSAGES,
) -> DataFrame:
    """The k nearest passages per query by cosine: query_id, passage_id,
    dense_score, rank_dense. Ties go to the smaller passage_id.

    ``vectors`` holds passage_id and vector, ``queries`` query_id and vector;
    both are hashed tokens, or plain numbers of ``dims`` dimensions with
    ``hashed=False``. Rows without a vector and vectors with a NaN, an infinite or
    a missing number are no hits (``broken_vectors`` lists them); a plain vector
    of another length is an error that names its row.
    """
    queries = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    vectors = vectors.where(F.col("vector").isNotNull())
    if not hashed:
        queries, vectors = checked_length(queries, "query_id", dims), checked_length(vectors, "passage_id", dims)
    return block_search(
        vectors.select("passage_id", "vector"), queries, None,
        lambda table, names: CosineScan(table, k, SCORE_DIGITS, dims, hashed),
        k, "dense_score", "rank_dense", local_queries, cell_passages,
    )
