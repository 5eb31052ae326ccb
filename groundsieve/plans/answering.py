"""From evidence bundles to checked answers, with one more round for those that fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundsieve.operators.answers import answer_drafts, final_responses, verification_reports
from groundsieve.operators.outputs import latest
from groundsieve.sources.staging import stage


@dataclass(frozen=True)
class Answers:
    drafts: DataFrame
    reports: DataFrame
    responses: DataFrame


def answer(
    bundles: DataFrame, answers: DataFrame | None = None, reports: DataFrame | None = None,
    second_answers: DataFrame | None = None, second_reports: DataFrame | None = None,
) -> Answers:
    """Drafts, reports and responses of all bundles.

    ``answers`` and ``reports`` are model outputs resolved by
    ``resolve_attempts``; without them the deterministic forms stand in. Where
    the first report is a fail and second answers are given, the question is
    answered and checked again and the second round counts, unless it came to
    no draft.
    """
    drafts = answer_drafts(bundles, answers).withColumn("round", F.lit(1))
    checks = verification_reports(drafts, bundles, reports).withColumn("round", F.lit(1))
    if second_answers is not None:
        checks = stage(checks, "reports")
        failed = checks.where("status = 'fail'").select("query_id")
        again = bundles.join(failed, "query_id", "left_semi")
        more = answer_drafts(again, second_answers).where("error IS NULL").withColumn(
            "round", F.lit(2))
        drafts = latest(drafts.unionByName(more), "round")
        checks = latest(checks.unionByName(verification_reports(more, again, second_reports)
                                           .withColumn("round", F.lit(2))), "round")
    drafts, checks = stage(drafts, "drafts"), stage(checks, "reports")
    return Answers(drafts, checks, final_responses(drafts, checks, bundles))
