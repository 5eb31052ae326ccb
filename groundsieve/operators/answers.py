"""Answer drafts, their verification and the response built from both.

A draft is a row per query: final_answer, claims, supporting_citations,
objections_raised, confidence_notes. Everything a query needs sits in its row
(the anchors of a bundle are few), so the checks are array predicates after
one join by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.functions.outputs import ANSWER, REPORT, spark_type
from groundsieve.functions.text import quote_found, strip
from groundsieve.operators.outputs import latest, matched_rounds
from groundsieve.sources.staging import stage

FALLBACK_ANCHORS = 3
QUOTE_LENGTH = 240

# Texts that mark or explain deterministic answers and reports.
FALLBACK_NOTES = (
    "Fallback extractive answer built from top evidence after schema validation failed.")
FALLBACK_MARK = "Fallback extractive answer built from top evidence"
FALLBACK_OBJECTION = (
    "This answer was assembled directly from the top retrieved passages because "
    "the local model did not return the required schema.")
OBJECTION_MARK = "local model did not return the required schema"
FALLBACK_REPORT_NOTES = (
    "Fallback verification used deterministic passage/citation checks because the "
    "local model did not return the required schema.")
UNMATCHED_CLAIM = "Fallback verification could not match all supporting passage IDs."
ABSENT_CITATION = "Citation passage was not present in the evidence bundle."
ALTERED_QUOTE = "Citation quote was not found verbatim in the anchor passage."
NO_EVIDENCE = "Answer generator failed and no evidence was available for fallback"

_CITATION = "array<struct<passage_id:string,issue:string>>"


def _ids(anchors: Column) -> Column:
    return F.transform(anchors, lambda a: a["passage_id"])


def _anchor(anchors: Column, passage_id: Column) -> Column:
    return F.get(F.filter(anchors, lambda a: a["passage_id"] == passage_id), 0)


def unknown_ids(answer: Column, anchors: Column) -> Column:
    """Passage ids that an answer refers to but the bundle does not hold."""
    used = F.concat(
        F.flatten(F.transform(answer["claims"], lambda c: c["supporting_passage_ids"])),
        F.transform(answer["supporting_citations"], lambda c: c["passage_id"]),
    )
    return F.array_except(used, _ids(anchors))


def altered_quotes(answer: Column, anchors: Column) -> Column:
    """Passage ids of citations whose quote is not in the anchor they name."""
    wrong = F.filter(answer["supporting_citations"], lambda c: ~F.coalesce(
        quote_found(_anchor(anchors, c["passage_id"])["text"], c["quote"]), F.lit(True)))
    return F.transform(wrong, lambda c: c["passage_id"])


def _kept_answer(answer: Column, anchors: Column) -> Column:
    """The answer without ids and citations that are not in the bundle."""
    known = _ids(anchors)
    return F.struct(
        answer["final_answer"].alias("final_answer"),
        F.transform(answer["claims"], lambda c: F.struct(
            c["claim_id"].alias("claim_id"), c["statement"].alias("statement"),
            F.filter(c["supporting_passage_ids"], lambda i: F.array_contains(known, i))
            .alias("supporting_passage_ids"),
            c["support_type"].alias("support_type"))).alias("claims"),
        F.filter(answer["supporting_citations"],
                 lambda c: F.array_contains(known, c["passage_id"])).alias("supporting_citations"),
        answer["objections_raised"].alias("objections_raised"),
        answer["confidence_notes"].alias("confidence_notes"),
    )


def _extractive_answer(anchors: Column) -> Column:
    """An answer made of the first anchors themselves."""
    top = F.slice(anchors, 1, FALLBACK_ANCHORS)
    return F.struct(
        F.array_join(F.transform(top, lambda a: strip(a["text"])), " ").alias("final_answer"),
        F.transform(top, lambda a, n: F.struct(
            F.concat(F.lit("fallback_c"), (n + 1).cast("string")).alias("claim_id"),
            strip(a["text"]).alias("statement"),
            F.array(a["passage_id"]).alias("supporting_passage_ids"),
            F.lit("direct").alias("support_type"))).alias("claims"),
        F.transform(top, lambda a: F.struct(
            a["passage_id"].alias("passage_id"),
            F.substring(strip(a["text"]), 1, QUOTE_LENGTH).alias("quote")))
        .alias("supporting_citations"),
        F.array(F.struct(F.lit(FALLBACK_OBJECTION).alias("issue"),
                         _ids(top).alias("related_passage_ids"))).alias("objections_raised"),
        F.lit(FALLBACK_NOTES).alias("confidence_notes"),
    )


def answer_drafts(bundles: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """A draft per bundle: the resolved model answer cleaned of unknown ids, or
    without one the extractive fallback; error is set if there is no evidence for it.

    ``results`` comes from ``resolve_attempts`` over answers. raw_unknown_ids
    and raw_citations describe the answer before cleaning.
    """
    base = bundles.select("query_id", "anchors")
    if results is None:
        joined = base.select(
            "*", F.lit(False).alias("success"), F.lit(0).alias("attempts"),
            F.lit(None).cast("string").alias("failure_reason"),
            F.lit(False).alias("repair_attempted"), F.lit(False).alias("repair_succeeded"),
            F.lit(None).cast(spark_type(ANSWER)).alias("parsed"))
    else:
        joined = base.join(results.drop("raw_outputs"), "query_id", "left")
    structured = F.coalesce("success", F.lit(False))
    some = F.size("anchors") > 0
    draft = F.when(structured, _kept_answer(F.col("parsed"), F.col("anchors"))).when(
        some, _extractive_answer(F.col("anchors")))
    answer = F.coalesce(F.col("parsed"), _extractive_answer(F.col("anchors")))
    return joined.withColumn("draft", draft).select(
        "query_id", F.col("draft.*"),
        F.when(structured, "structured").otherwise("fallback").alias("mode"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        structured.alias("structured_success"),
        F.coalesce("repair_attempted", F.lit(False)).alias("repair_attempted"),
        F.coalesce("repair_succeeded", F.lit(False)).alias("repair_succeeded"),
        "failure_reason", (~structured).alias("fallback_used"),
        F.when(structured, unknown_ids(F.col("parsed"), F.col("anchors")))
        .otherwise(F.array().cast("array<string>")).alias("raw_unknown_ids"),
        F.transform(answer["supporting_citations"], lambda c: c["passage_id"])
        .alias("raw_citations"),
        F.when(~structured & ~some, NO_EVIDENCE).alias("error"),
    )


def _deterministic_report(anchors: Column) -> Column:
    """Checks claims and citations against the anchors; never better than a pass with warnings."""
    known = _ids(anchors)

    def backed(c: Column) -> Column:
        ids = c["supporting_passage_ids"]
        return (F.size(ids) > 0) & (F.size(F.array_except(ids, known)) == 0)

    claims = F.col("claims")
    open_claims = F.filter(claims, lambda c: ~backed(c))

    def issue(c: Column) -> Column:
        text = _anchor(anchors, c["passage_id"])["text"]
        return F.when(F.coalesce(text, F.lit("")) == "", ABSENT_CITATION).when(
            ~quote_found(text, c["quote"]), ALTERED_QUOTE)

    issues = F.transform("supporting_citations", lambda c: F.struct(
        c["passage_id"].alias("passage_id"), issue(c).alias("issue")))
    return F.struct(
        F.when(F.size(open_claims) > 0, "fail").otherwise("pass_with_warnings").alias("status"),
        F.transform(F.filter(claims, backed), lambda c: c["claim_id"]).alias("supported_claims"),
        F.transform(open_claims, lambda c: F.struct(
            c["claim_id"].alias("claim_id"), F.lit(UNMATCHED_CLAIM).alias("reason")))
        .alias("unsupported_claims"),
        F.filter(issues, lambda i: i["issue"].isNotNull()).alias("citation_issues"),
        F.lit(FALLBACK_REPORT_NOTES).alias("notes"),
    ).cast(spark_type(REPORT))


def _kept_report(report: Column, anchors: Column) -> Column:
    """The model's report without claims and passages that do not exist."""
    known = _ids(anchors)
    claims = F.transform("claims", lambda c: c["claim_id"])
    return F.struct(
        report["status"].alias("status"), report["supported_claims"].alias("supported_claims"),
        F.filter(report["unsupported_claims"],
                 lambda u: F.array_contains(claims, u["claim_id"])).alias("unsupported_claims"),
        F.filter(report["citation_issues"],
                 lambda i: F.array_contains(known, i["passage_id"])).alias("citation_issues"),
        report["notes"].alias("notes"),
    )


def is_fallback_draft() -> Column:
    return F.contains(F.col("confidence_notes"), F.lit(FALLBACK_MARK)) | F.exists(
        "objections_raised", lambda o: F.contains(o["issue"], F.lit(OBJECTION_MARK)))


def verification_reports(
    drafts: DataFrame, bundles: DataFrame, results: DataFrame | None = None
) -> DataFrame:
    """A report per draft. Fallback drafts, and drafts whose model report did
    not resolve, are checked deterministically; else the model's report counts."""
    base = drafts.where(F.col("error").isNull()).select(
        "query_id", "claims", "supporting_citations", "objections_raised", "confidence_notes"
    ).join(bundles.select("query_id", "anchors"), "query_id")
    if results is None:
        joined = base.select(
            "*", F.lit(False).alias("success"), F.lit(0).alias("attempts"),
            F.lit(None).cast("string").alias("failure_reason"),
            F.lit(False).alias("repair_attempted"), F.lit(False).alias("repair_succeeded"),
            F.lit(None).cast(spark_type(REPORT)).alias("parsed"))
    else:
        joined = base.join(results.drop("raw_outputs"), "query_id", "left")
    skipped = is_fallback_draft()
    structured = ~skipped & F.coalesce("success", F.lit(False))
    report = F.when(structured, _kept_report(F.col("parsed"), F.col("anchors"))).otherwise(
        _deterministic_report(F.col("anchors")))

    def unless_skipped(column: str, default) -> Column:
        return F.when(skipped, F.lit(default)).otherwise(F.coalesce(column, F.lit(default)))

    return joined.withColumn("report", report).select(
        "query_id", F.col("report.*"),
        F.when(skipped, "deterministic_skip").when(structured, "structured")
        .otherwise("deterministic_fallback").alias("mode"),
        unless_skipped("attempts", 0).alias("attempts"),
        structured.alias("structured_success"),
        unless_skipped("repair_attempted", False).alias("repair_attempted"),
        unless_skipped("repair_succeeded", False).alias("repair_succeeded"),
        F.when(skipped, "skipped_for_fallback_answer").otherwise(F.col("failure_reason"))
        .alias("failure_reason"),
        (~structured).alias("fallback_used"),
    )


def citation_rows(drafts: DataFrame, bundles: DataFrame) -> DataFrame:
    """One row per citation with the title and text of its anchor (null and '' without one)."""
    cited = drafts.select("query_id", F.posexplode("supporting_citations").alias("place", "c"))
    found = cited.join(bundles.select("query_id", "anchors"), "query_id", "left").withColumn(
        "anchor", _anchor(F.col("anchors"), F.col("c.passage_id")))
    return found.select(
        "query_id", "place", F.col("c.passage_id").alias("passage_id"),
        F.col("c.quote").alias("quote"), F.col("anchor.section_title").alias("section_title"),
        F.coalesce("anchor.text", F.lit("")).alias("passage_text"))


def final_responses(drafts: DataFrame, reports: DataFrame, bundles: DataFrame) -> DataFrame:
    """What the asker gets, by report status: the answer, the answer with
    warnings, or a blank answer with an error. A draft that has no report (there
    was no evidence for it) or no bundle fails with the draft's own error."""
    rows = (
        drafts.select("query_id", "final_answer", "supporting_citations", "objections_raised",
                      "confidence_notes", F.col("error").alias("draft_error"))
        .join(reports.select("query_id", "status", "unsupported_claims", "citation_issues",
                             "notes"), "query_id", "left")
        .join(bundles.select("query_id", "anchors"), "query_id", "left")
    )
    good = F.coalesce(F.col("status").isin("pass", "pass_with_warnings"), F.lit(False))
    n_open = F.coalesce(F.size("unsupported_claims"), F.lit(0))
    n_issues = F.coalesce(F.size("citation_issues"), F.lit(0))
    notes = F.coalesce("notes", F.lit(""))
    debug = F.concat(F.lit("/queries/"), "query_id", F.lit("/retrieval-debug"))

    def cited(c: Column) -> Column:
        anchor = _anchor(F.col("anchors"), c["passage_id"])
        return F.struct(
            c["passage_id"].alias("passage_id"), c["quote"].alias("quote"),
            anchor["section_title"].alias("section_title"),
            F.coalesce(anchor["text"], F.lit("")).alias("passage_text"))

    none_cited = F.array().cast(drafts.schema["supporting_citations"].dataType)
    citations = F.transform(F.coalesce("supporting_citations", none_cited), cited)
    objections = F.transform("objections_raised", lambda o: o["issue"])
    soft = F.array_compact(F.array(
        F.when(n_open > 0, F.concat(n_open.cast("string"),
                                    F.lit(" claim(s) could not be fully verified."))),
        F.when(n_issues > 0, F.concat(n_issues.cast("string"),
                                      F.lit(" citation issue(s) detected."))),
        F.when(notes != "", notes),
    ))
    hard = F.array(
        F.lit("The answer could not be verified against the source text."),
        F.concat(F.lit("Unsupported claims: "), n_open.cast("string")), notes,
    )
    none = F.array().cast("array<string>")
    return rows.select(
        "query_id",
        F.when(good, F.col("final_answer")).otherwise("").alias("final_answer"),
        F.when(good, citations).otherwise(F.slice(citations, 1, 0)).alias("citations"),
        F.when(good, objections).otherwise(none).alias("objections"),
        F.when(good, F.col("confidence_notes")).otherwise("").alias("confidence_notes"),
        F.when(good, F.col("status")).otherwise("fail").alias("verification_status"),
        F.when(F.col("status") == "pass", none).when(good, soft)
        .when(F.col("status").isNull(), none).otherwise(hard).alias("verification_warnings"),
        debug.alias("debug_url"),
        F.when(F.col("status").isNull(), F.coalesce("draft_error", F.lit(NO_EVIDENCE))).when(~good, F.concat(
            F.lit("Verification failed. The answer contained "), n_open.cast("string"),
            F.lit(" unsupported claim(s). See "), debug, F.lit(" for details."))).alias("error"),
    )


def query_overview(
    questions: DataFrame, bundles: DataFrame, drafts: DataFrame, reports: DataFrame
) -> DataFrame:
    """Every question with its newest draft, citations and report status, where it has them."""
    rows = (
        questions.select("query_id", "question")
        .join(bundles.select("query_id", "anchors"), "query_id", "left")
        .join(drafts.select("query_id", "final_answer", "supporting_citations",
                            "objections_raised"), "query_id", "left")
        .join(reports.select("query_id", "status"), "query_id", "left")
    )
    citations = F.transform("supporting_citations", lambda c: F.struct(
        c["passage_id"].alias("passage_id"), c["quote"].alias("quote"),
        _anchor(F.col("anchors"), c["passage_id"])["section_title"].alias("section_title"),
        F.coalesce(_anchor(F.col("anchors"), c["passage_id"])["text"], F.lit(""))
        .alias("passage_text")))
    return rows.select(
        "query_id", "question", F.coalesce("final_answer", F.lit("")).alias("final_answer"),
        F.coalesce(F.when(F.col("anchors").isNotNull(), citations), F.slice(citations, 1, 0),
                   F.array()).alias("citations"),
        F.coalesce(F.transform("objections_raised", lambda o: o["issue"]),
                   F.array().cast("array<string>")).alias("objections"),
        F.coalesce("status", F.lit("unknown")).alias("verification_status"),
    )


def query_overview_as_of(
    questions: DataFrame, bundles: DataFrame, drafts: DataFrame, reports: DataFrame,
    at: str = "created_at", tie: str = "artifact_id", moment=None,
) -> DataFrame:
    """``query_overview`` over artifacts of several rounds: the newest draft of each question,
    by ``moment`` if one is given, with the bundle and the report of its own round."""
    if moment is not None:
        bundles, drafts, reports = (t.where(F.col(at) <= F.lit(moment)) for t in (bundles, drafts, reports))
    rounds = stage(latest(matched_rounds(bundles, drafts, reports, at, tie), "round"), "rounds")
    return query_overview(questions, *[
        rounds.where(F.col(name).isNotNull()).select("query_id", *[
            F.col(name)[c].alias(c) for c in table.columns if c != "query_id"])
        for name, table in (("bundle", bundles), ("draft", drafts), ("report", reports))])


def objection_issues(raw: Column) -> Column:
    """Issues of stored objections, a JSON array of strings or of objects with an issue."""
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.transform(items, lambda o: F.coalesce(
        F.try_variant_get(o, "$.issue", "string"), F.try_variant_get(o, "$", "string")))
