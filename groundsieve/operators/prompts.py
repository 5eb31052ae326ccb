"""Prompt tables for an outside model: one prompt per query."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.functions.outputs import json_schema

# The wording of the prompts.
_ANSWER_RULES = (
    "Instructions:\nAnswer using ONLY the provided passages.\nCite passages using passage_id.\n"
    "Return structured JSON according to the schema.\nReturn ONLY valid JSON, no other text.")
_VERIFY_RULES = (
    "Instructions:\nVerify whether every claim in the answer draft is supported by the cited "
    "evidence passages.\nReturn structured JSON according to the schema.\n"
    "Return ONLY valid JSON, no other text.")
_CORRECTION = (
    "Your previous response was invalid.\nReturn ONLY a valid JSON object.\n"
    "Do not include markdown, code fences, commentary, or explanations.\n"
    "Follow the schema exactly and preserve the intended meaning of your prior answer.\n")


def _evidence(windows: bool) -> Column:
    def item(a: Column) -> Column:
        fields = [a["passage_id"].alias("passage_id"), a["text"].alias("text"),
                  F.coalesce(a["section_title"], F.lit("")).alias("section_title")]
        if windows:
            fields += [a["rank"].alias("rank"), a["window_text"].alias("window_text")]
        return F.struct(*fields)

    return F.to_json(F.struct(
        F.col("question").alias("query"), F.lit("source_only").alias("mode"),
        F.transform("anchors", item).alias("anchors")))


def answer_prompts(questions: DataFrame, bundles: DataFrame) -> DataFrame:
    rows = questions.select("query_id", "question").join(bundles, "query_id")
    return rows.select("query_id", F.concat(
        F.lit("Question:\n"), "question", F.lit("\n\nMode:\nsource_only\n\nEvidence Passages:\n"),
        _evidence(True), F.lit("\n\n" + _ANSWER_RULES)).alias("prompt"))


def verifier_prompts(questions: DataFrame, bundles: DataFrame, drafts: DataFrame) -> DataFrame:
    rows = questions.select("query_id", "question").join(
        bundles.select("query_id", "anchors"), "query_id").join(
        drafts.select("query_id", "final_answer", "claims", "supporting_citations"), "query_id")
    draft = F.to_json(F.struct("final_answer", "claims", "supporting_citations"))
    return rows.select("query_id", F.concat(
        F.lit("Question:\n"), "question", F.lit("\n\nEvidence Passages:\n"), _evidence(False),
        F.lit("\n\nAnswer Draft to Verify:\n"), draft, F.lit("\n\n" + _VERIFY_RULES))
        .alias("prompt"))


def correction_prompts(checked: DataFrame, prompts: DataFrame, shape: dict) -> DataFrame:
    """The follow-up prompt of every failed attempt that came with an output."""
    schema = json.dumps(json_schema(shape), indent=2)
    failed = checked.where(F.col("failure_stage").isin("json_parse", "schema_validation"))
    return failed.join(prompts, "query_id").select("query_id", "attempt", F.concat(
        "prompt", F.lit("\n\n" + _CORRECTION + "Failure reason: "), "failure_reason",
        F.lit(f"\n\nExpected JSON schema:\n{schema}\n\nPrevious invalid output:\n"),
        "raw_output").alias("prompt"))
