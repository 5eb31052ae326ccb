"""BM25: the index tables and top-k search for a whole table of questions."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.config import BM25_B, BM25_IDF_FLOOR, BM25_K1, SCORE_DIGITS, STOP_WORDS
from groundsieve.functions import tokenblocks
from groundsieve.functions.nearest import TermScan
from groundsieve.functions.text import (
    INFLECTED_STOP, SPACE_CHARS, expand_terms, lexical_tokens, normalize_question,
)
from groundsieve.operators.blockwise import CELL_PASSAGES, LOCAL_QUERIES, block_search
from groundsieve.sources.staging import bounded, stage

# The kernels travel with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(tokenblocks)

_ENTRIES = "array<struct<term:string,tf:int>>"


@dataclass(frozen=True)
class LexicalIndex:
    """passage_terms(passage_id, length, entries), term_stats(term, df) and
    the one-row corpus_stats(n_passages, mean_length, mean_idf)."""

    passage_terms: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """passage_id, length, term, tf."""
        return self.passage_terms.select("passage_id", "length", F.inline("entries"))

    def staged(self) -> "LexicalIndex":
        """The same index over written tables, each built from the ones before."""
        return LexicalIndex(stage(self.passage_terms, "passage_terms"), None, None).with_statistics()

    def with_statistics(self) -> "LexicalIndex":
        """The index of these passage_terms, which are a written table, with statistics written anew."""
        terms = self.passage_terms
        stats = stage(term_statistics(terms), "term_stats")
        corpus = stage(corpus_statistics(terms, stats), "corpus_stats")
        return LexicalIndex(terms, stats, corpus)


def term_counts(tokens: Column) -> Column:
    """Distinct tokens with their counts, as (term, tf)."""
    return F.arrow_udf(tokenblocks.counted, _ENTRIES)(tokens)


def index_columns(text: Column, compat: bool = False, dims: int | None = None) -> Column:
    """The length and entries of ``lexical_tokens`` and, with ``dims``, the vector of ``hash_codes``
    as one struct: the text goes through Python once, and a word that a batch repeats is stemmed once."""
    indexer = tokenblocks.Indexer(list(STOP_WORDS), [] if compat else list(INFLECTED_STOP), SPACE_CHARS, dims)

    def indexed(texts: pa.Array) -> pa.Array:
        return indexer(texts)

    vector = "" if dims is None else ",vector:array<int>"
    return F.arrow_udf(indexed, f"struct<length:int,entries:{_ENTRIES}{vector}>")(F.lower(text))


def token_length(counted: str) -> Column:
    """The number of tokens; of a missing text what Spark takes for the size of a missing array."""
    return F.coalesce(F.col(counted), F.size(F.lit(None).cast("array<string>"))).alias("length")


def term_statistics(passage_terms: DataFrame) -> DataFrame:
    terms = passage_terms.select(F.explode("entries.term").alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_statistics(passage_terms: DataFrame, term_stats: DataFrame) -> DataFrame:
    sizes = passage_terms.agg(
        F.count("*").alias("n_passages"), F.avg("length").alias("mean_length"))
    return mean_idf(sizes, term_stats)


def mean_idf(sizes: DataFrame, term_stats: DataFrame) -> DataFrame:
    """The one row of sizes(n_passages, mean_length) with the mean idf of all terms."""
    n = sizes.select("n_passages").scalar()
    raw = term_stats.select(_raw_idf(n, F.col("df")).alias("raw"))
    return sizes.withColumn("mean_idf", raw.agg(F.avg("raw").alias("mean_idf")).scalar())


def build_lexical_index(passages: DataFrame, compat: bool = False) -> LexicalIndex:
    """Index of passages(passage_id, normalized_text). Counting terms needs no
    shuffle; only the document frequencies do, after partial sums."""
    counted = passages.select("passage_id", index_columns(F.col("normalized_text"), compat).alias("indexed"))
    terms = counted.select("passage_id", token_length("indexed.length"), "indexed.entries")
    stats = term_statistics(terms)
    return LexicalIndex(terms, stats, corpus_statistics(terms, stats))


def prepare_questions(
    questions: DataFrame, expansions: dict | None = None, enabled: bool = True,
    compat: bool = False,
) -> DataFrame:
    """Adds the normalised question, its tokens, the expansion terms and the lexical query.

    search_terms are what the index is asked for: the distinct terms; under
    ``compat`` they pass the tokeniser once more and are stemmed twice.
    """
    tokens = F.col("normalized_tokens")
    expanded = expand_terms(tokens, dict(expansions or {}) if enabled else {}, compat)
    lexical_query = F.array_join(F.array_distinct(F.concat(tokens, "expanded_terms")), " ")
    again = (
        lexical_tokens(F.col("lexical_query"), compat=True) if compat
        else F.array_remove(F.split("lexical_query", " "), "")
    )
    return (
        questions.withColumn("normalized_question", normalize_question(F.col("question")))
        .withColumn("normalized_tokens", lexical_tokens(F.col("normalized_question"), compat))
        .withColumn("expanded_terms", expanded)
        .withColumn("lexical_query", lexical_query)
        .withColumn("search_terms", again)
    )


def query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, weight: term count times idf, with the floor for terms
    that stand in more than half of the passages."""
    stats = index.corpus_stats
    raw = _raw_idf(stats.select("n_passages").scalar(), F.col("df"))
    floor = stats.select(F.col("mean_idf") * BM25_IDF_FLOOR).scalar()
    asked = queries.select("query_id", F.inline(term_counts(F.col("search_terms"))))
    return (
        asked.join(index.term_stats, "term")
        .withColumn("raw_idf", raw)
        .select(
            "query_id", "term",
            (F.col("tf") * F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))
             * (BM25_K1 + 1)).alias("weight"),
        )
    )


def bm25_scores(index: LexicalIndex, queries: DataFrame, salts: int = 32,
                broadcast_rows: int | None = None) -> DataFrame:
    """query_id, passage_id, lexical_score for every passage that shares a term with the query.

    The question side is broadcast only after its row count is checked. The
    postings of asked terms are then hashed by passage, once: a passage's
    terms stay together, so the sums need no further shuffle and a frequent
    term is spread over all tasks. A question side too big for that is joined
    by term and salt, which splits every frequent term over ``salts`` tasks.
    """
    weights = query_weights(index, queries)
    asked = queries.select(F.explode("search_terms").alias("term"))
    small = bounded(asked, broadcast_rows) if broadcast_rows is not None else bounded(asked)
    postings = index.postings
    if small:
        wanted = postings.join(F.broadcast(asked.distinct()), "term", "left_semi")
        matched = wanted.repartition("passage_id").join(F.broadcast(weights), "term")
    else:
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("passage_id"), F.lit(salts)))
        copies = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        matched = salted.join(copies, ["term", "salt"])
    mean_length = index.corpus_stats.select("mean_length").scalar()
    damped = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / mean_length)
    part = F.col("weight") * F.col("tf") / damped
    return matched.groupBy("query_id", "passage_id").agg(
        F.round(F.sum(part), SCORE_DIGITS).alias("lexical_score"))


def bm25_search(
    index: LexicalIndex, queries: DataFrame, k: int, compat: bool = False,
    local_queries: int = LOCAL_QUERIES, cell_passages: int = CELL_PASSAGES,
) -> DataFrame:
    """The k best passages per query(query_id, search_terms): query_id,
    passage_id, lexical_score, rank_lexical. Ties go to the smaller passage_id.

    Joining postings and questions by term would make a row of every pair
    that shares a frequent term; the passages are scored in blocks instead.
    Only positive scores count. ``compat`` fills short lists up with
    zero-score passages.
    """
    mean_length = index.corpus_stats.select("mean_length").scalar()
    passages = index.passage_terms.select(
        "passage_id", F.col("entries.term").alias("terms"), F.col("entries.tf").alias("tf"),
        (BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / mean_length)).alias("damping"),
    )
    if not compat:
        passages = passages.where(F.size("terms") > 0)
    return block_search(
        passages, queries.select("query_id"), query_weights(index, queries),
        lambda table, names: TermScan(
            table.filter(table.column("term").is_valid()), names, k, SCORE_DIGITS, not compat),
        k, "lexical_score", "rank_lexical", local_queries, cell_passages,
    )
