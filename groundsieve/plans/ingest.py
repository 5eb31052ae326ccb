"""Documents to the tables of a searchable corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundsieve.config import HASH_DIMS, RetrievalConfig
from groundsieve.operators.lexical import (
    LexicalIndex, corpus_statistics, index_columns, term_statistics, token_length,
)
from groundsieve.operators.splitting import (
    passages_table, sections_table, split_documents, windows_table,
)
from groundsieve.sources.staging import stage

_INDEXED = "indexed"


@dataclass(frozen=True)
class Corpus:
    sections: DataFrame
    passages: DataFrame
    windows: DataFrame


@dataclass(frozen=True)
class CorpusIndex:
    passages: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame
    hashed: bool = True
    dims: int = HASH_DIMS


def ingest(documents: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> Corpus:
    """Normalises and splits documents(document_id, text, sectioning_strategy,
    passage_strategy[, section_boundaries]); lazy, and free of shuffles."""
    split = split_documents(documents, config.compat)
    return Corpus(sections_table(split), passages_table(split),
                  windows_table(split, config.context_window_radius))


def ingest_once(documents: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> Corpus:
    """The tables of ``ingest`` as views of one written table of split documents, nested as they
    came out of the split: each document is split once, and a view of sections does not read
    the passages, nor one of passages the sections."""
    split = split_documents(documents, config.compat)
    # Text and title of a section stand with its passages or its offsets; the raw text stays behind.
    sections = F.transform("sections", lambda s: s.dropFields("text"))
    held = stage(split.select("document_id", sections.alias("sections"), "passages"), "split_documents")
    return Corpus(sections_table(held), passages_table(held), windows_table(held, config.context_window_radius))


def build_index(
    passages: DataFrame, config: RetrievalConfig = RetrievalConfig(),
    vectors: DataFrame | None = None, dims: int = HASH_DIMS, staged: bool = True,
) -> CorpusIndex:
    """Lexical and dense index of a passage table.

    ``vectors``(passage_id, vector) replaces the hashing embedder. ``staged``
    writes the tables first, so that statistics and searches do not redo the
    splitting.
    """
    own = vectors is None
    rows = indexed_passages(passages, config.compat, dims if own else None)
    if staged:
        rows = stage(rows, "indexed_passages")
    lexical = LexicalIndex(terms_of(rows), None, None)
    if staged:
        lexical = lexical.with_statistics()
    else:
        stats = term_statistics(lexical.passage_terms)
        lexical = LexicalIndex(lexical.passage_terms, stats, corpus_statistics(lexical.passage_terms, stats))
    return CorpusIndex(passages_of(rows), lexical, vectors_of(rows) if own else vectors, own, dims)


def indexed_passages(passages: DataFrame, compat: bool = False, dims: int | None = HASH_DIMS) -> DataFrame:
    """The passages with what the index holds of each, in one table whose readers take their own columns:
    a text is split, counted and hashed in one pass. A normalized_text that is the text itself
    is not kept a second time."""
    text, normalized = F.col("text"), F.col("normalized_text")
    rows = passages.withColumn(_INDEXED, index_columns(normalized, compat, dims))
    if {"text", "normalized_text"} <= set(passages.columns):
        rows = rows.withColumn("normalized_text", F.when(~normalized.eqNullSafe(text), F.struct(normalized.alias("own"))))
    return rows


def passages_of(rows: DataFrame) -> DataFrame:
    passages = rows.drop(_INDEXED)
    if not {"text", "normalized_text"} <= set(passages.columns):
        return passages
    text, normalized = F.col("text"), F.col("normalized_text")
    return passages.withColumn("normalized_text", F.when(normalized.isNull(), text).otherwise(normalized["own"]))


def terms_of(rows: DataFrame, *keys: str) -> DataFrame:
    """passage_id, length and entries of indexed passages, with the columns ``keys``."""
    return rows.select("passage_id", token_length(f"{_INDEXED}.length"), f"{_INDEXED}.entries", *keys)


def vectors_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select("passage_id", f"{_INDEXED}.vector", *keys)
