"""The registered queries of this package: name to a function of (spark, table folder)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from groundsieve.llm.alignment import AlignmentOptions, alignment_table
from groundsieve.llm.byte_bpe import ByteBpeOptions, byte_bpe_digests
from groundsieve.llm.common import table
from groundsieve.llm.decontamination import leaks
from groundsieve.llm.html_extraction import main_texts
from groundsieve.llm.lexical_search import ranked_documents
from groundsieve.llm.line_dedup import line_report
from groundsieve.llm.lm_scoring import pseudo_likelihoods
from groundsieve.llm.near_duplicates import near_duplicate_classes
from groundsieve.llm.packing import PackingOptions, pack_documents
from groundsieve.llm.quality import quality_table
from groundsieve.llm.token_files import TokenFileOptions, token_digests
from groundsieve.llm.toxicity import toxicity_table
from groundsieve.llm.warc import warc_digests

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = AlignmentOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
BYTE_BPE = ByteBpeOptions(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_toxicity(spark, folder) -> DataFrame:
    return toxicity_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_ngram_jaccard(spark, folder) -> DataFrame:
    return near_duplicate_classes(table(spark, folder, "documents"))


def op2_token_files(spark, folder) -> DataFrame:
    return token_digests(table(spark, folder, "documents"), TokenFileOptions(TOKENIZER))


def op3_warc_salvage(spark, folder) -> DataFrame:
    return warc_digests(table(spark, folder, "pages"))


def op4_line_dedup(spark, folder) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


def op5_quality_rules(spark, folder) -> DataFrame:
    return quality_table(table(spark, folder, "documents"))


def op6_best_fit_packing(spark, folder) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), PackingOptions(TOKENIZER))


def op7_benchmark_leaks(spark, folder) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_pseudo_likelihood(spark, folder) -> DataFrame:
    return pseudo_likelihoods(table(spark, folder, "documents"))


def op9_html_extraction(spark, folder) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op11_byte_bpe(spark, folder) -> DataFrame:
    return byte_bpe_digests(table(spark, folder, "documents"), BYTE_BPE)


def op12_alignment(spark, folder) -> DataFrame:
    return alignment_table(table(spark, folder, "documents"), ALIGNED)


def op13_ranked_search(spark, folder) -> DataFrame:
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def registered() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}
