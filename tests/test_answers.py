import json

import pytest
from pyspark.sql import functions as F

from groundsieve.functions.json_repair import first_block, json_candidate, without_fence
from groundsieve.functions.outputs import ANSWER, REPORT, json_schema, spark_type
from groundsieve.operators import answers as A
from groundsieve.operators.outputs import check_outputs, latest, resolve_attempts
from groundsieve.operators.prompts import answer_prompts, correction_prompts, verifier_prompts

GOOD = {
    "final_answer": "Patience wins.",
    "claims": [{"claim_id": "c1", "statement": "s", "supporting_passage_ids": ["p1"],
                "support_type": "direct"}],
    "supporting_citations": [{"passage_id": "p1", "quote": "wears down"}],
    "objections_raised": [], "confidence_notes": "sure",
}
ATTEMPTS = "query_id string, attempt int, raw_output string, transport_error string"


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    *way, last = path
    at = out
    for step in way:
        at = at[step]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return json.dumps(out)


def checked(spark, outputs, shape=ANSWER):
    rows = spark.createDataFrame([(f"q{n:02d}", 1, o, None) for n, o in enumerate(outputs)], ATTEMPTS)
    got = check_outputs(rows, shape).orderBy("query_id").collect()
    return [(r["failure_stage"], r["repair_attempted"], r["repair_succeeded"]) for r in got]


def test_json_blocks():
    assert first_block('x {"a": "}{", "b": {"c": 1}} y {') == '{"a": "}{", "b": {"c": 1}}'
    assert first_block(r'{"a": "q\"}"} tail') == r'{"a": "q\"}"}'
    assert first_block("[1, [2]] {") == "[1, [2]]"
    assert first_block('{"a": ') is None and first_block("none") is None
    assert first_block('{"open string }') is None
    assert without_fence("```json\n{}\n```") == "{}" and without_fence("{}") == "{}"
    assert json_candidate("```{\n{\"a\": 1}\n```") == '{"a": 1}'
    assert json_candidate("  text ") is None
    # What looks like JSON as a whole is taken as a whole.
    assert json_candidate('{"a": 1} and {b}') == '{"a": 1} and {b}'


def test_outputs_that_pass(spark):
    text = json.dumps(GOOD)
    assert checked(spark, [text, f"```json\n{text}\n```", f"Sure:\n{text}\nDone.", changed(["extra"], 1),
                           changed(["claims"], [])]) == [
        (None, False, False), (None, True, True), (None, True, True), (None, False, False),
        (None, False, False)]


@pytest.mark.parametrize("path, value", [
    (["final_answer"], None), (["final_answer"], 5), (["claims"], {}), (["claims"], "c1"),
    (["claims", 0, "support_type"], "maybe"), (["claims", 0, "statement"], None),
    (["claims", 0, "supporting_passage_ids"], "p1"), (["claims", 0, "supporting_passage_ids"], [1]),
    (["supporting_citations", 0, "quote"], None), (["objections_raised"], [{"issue": "x"}]),
    (["confidence_notes"], ["sure"]), (["claims"], [GOOD["claims"][0], "c2"]),
])
def test_outputs_of_the_wrong_shape(spark, path, value):
    assert checked(spark, [changed(path, value), "x" + changed(path, value)]) == [
        ("schema_validation", False, False), ("schema_validation", True, True)]


def test_outputs_that_do_not_parse(spark):
    assert checked(spark, ['{"final_answer": ', "{'a': 1}", "plain words", "", "{'a': 1} {"]) == [
        ("json_parse", True, False)] * 5
    assert checked(spark, ["null", "[]", "3", '"text"']) == [("schema_validation", False, False)] * 4


def test_reports(spark):
    report = {"status": "pass", "supported_claims": ["c1"], "unsupported_claims": [],
              "citation_issues": [], "notes": ""}
    assert [s for s, *_ in checked(spark, [json.dumps(report), json.dumps(report | {"status": "ok"}),
                                           json.dumps({"status": "pass"})], REPORT)] == [
        None, "schema_validation", "schema_validation"]


def test_shapes():
    assert spark_type(REPORT).startswith("struct<status:string,supported_claims:array<string>,")
    schema = json_schema(ANSWER)
    assert schema["required"] == list(ANSWER)
    assert schema["properties"]["claims"]["items"]["properties"]["support_type"]["enum"] == [
        "direct", "interpretive"]


def test_attempts_end_at_the_first_valid_one(spark):
    text, bad = json.dumps(GOOD), "{"
    rows = [
        ("first", 1, text, None), ("first", 2, bad, None),
        ("second", 1, "```\n" + changed(["claims"], 1) + "\n```", None), ("second", 2, text, None),
        ("lost", 1, None, "timed out"), ("lost", 2, text, None),
        ("never", 1, bad, None), ("never", 2, bad, None), ("never", 3, changed(["claims"], 1), None),
        ("never", 4, text, None),
    ]
    table = spark.createDataFrame(rows, ATTEMPTS).repartition(5)
    got = {r["query_id"]: r for r in resolve_attempts(check_outputs(table, ANSWER)).collect()}

    def brief(q):
        r = got[q]
        return (r["success"], r["attempts"], r["repair_attempted"], r["repair_succeeded"],
                len(r["raw_outputs"]), r["parsed"] is not None)

    assert brief("first") == (True, 1, False, False, 1, True)
    assert brief("second") == (True, 2, True, True, 2, True)
    assert brief("lost") == (False, 1, False, False, 0, False)
    assert got["lost"]["failure_reason"] == "llm_error: timed out"
    assert brief("never") == (False, 3, True, False, 3, False)
    assert got["never"]["failure_reason"] == "schema_validation: claims"


ANCHOR = ("struct<passage_id:string,text:string,rank:int,scores:map<string,double>,"
          "section_title:string,section_order_index:int,window_passage_ids:array<string>,"
          "window_text:string,kept_text:string>")


def anchor(p, text, rank):
    return (p, text, rank, {"hybrid": 0.5}, f"title {p}", 0, [p], text, text)


@pytest.fixture(scope="module")
def bundles(spark):
    four = [anchor("p1", "Patience wears down stone.", 1), anchor("p2", " " + "long " * 60, 2),
            anchor("p3", "Mercy.", 3), anchor("p4", "Salt.", 4)]
    return spark.createDataFrame(
        [("q1", "source_only", four), ("q2", "source_only", four[:1]), ("q3", "source_only", [])],
        f"query_id string, mode string, anchors array<{ANCHOR}>")


def results_of(spark, outputs, shape=ANSWER):
    rows = spark.createDataFrame([(q, 1, o, None) for q, o in outputs.items()], ATTEMPTS)
    return resolve_attempts(check_outputs(rows, shape))


def one(df, query="q1"):
    return df.where(F.col("query_id") == query).first()


def test_fallback_answer(bundles):
    drafts = A.answer_drafts(bundles)
    row = one(drafts)
    assert row["mode"] == "fallback" and row["fallback_used"] and not row["structured_success"]
    assert row["final_answer"] == "Patience wears down stone. " + ("long " * 60).strip() + " Mercy."
    assert [c["claim_id"] for c in row["claims"]] == ["fallback_c1", "fallback_c2", "fallback_c3"]
    assert [c["passage_id"] for c in row["supporting_citations"]] == ["p1", "p2", "p3"]
    assert row["supporting_citations"][1]["quote"] == ("long " * 60)[:240]
    assert row["objections_raised"][0]["related_passage_ids"] == ["p1", "p2", "p3"]
    assert one(drafts, "q3")["error"] == A.NO_EVIDENCE and one(drafts, "q3")["final_answer"] is None


def test_unknown_ids_are_removed_but_remembered(spark, bundles):
    text = json.dumps(GOOD | {
        "claims": [GOOD["claims"][0] | {"supporting_passage_ids": ["p1", "ghost"]}],
        "supporting_citations": [{"passage_id": "other", "quote": "x"},
                                 {"passage_id": "p1", "quote": "not there"}]})
    results = results_of(spark, {"q1": text})
    row = one(A.answer_drafts(bundles, results))
    assert row["mode"] == "structured" and row["raw_unknown_ids"] == ["ghost", "other"]
    assert row["claims"][0]["supporting_passage_ids"] == ["p1"]
    assert [c["passage_id"] for c in row["supporting_citations"]] == ["p1"]
    assert row["raw_citations"] == ["other", "p1"]
    both = results.join(bundles, "query_id")
    got = both.select(A.altered_quotes(F.col("parsed"), F.col("anchors"))).first()[0]
    assert got == ["p1"]


def test_deterministic_report(spark, bundles):
    text = json.dumps(GOOD | {
        "claims": [GOOD["claims"][0], GOOD["claims"][0] | {"claim_id": "c2", "supporting_passage_ids": []}],
        "supporting_citations": [{"passage_id": "p1", "quote": "not there"},
                                 {"passage_id": "p1", "quote": ""}]})
    drafts = A.answer_drafts(bundles, results_of(spark, {"q1": text}))
    row = one(A.verification_reports(drafts, bundles))
    assert (row["status"], row["mode"]) == ("fail", "deterministic_fallback")
    assert row["supported_claims"] == ["c1"]
    assert [u["claim_id"] for u in row["unsupported_claims"]] == ["c2"]
    assert [tuple(i) for i in row["citation_issues"]] == [("p1", A.ALTERED_QUOTE)]


def test_fallback_drafts_skip_the_model_report(spark, bundles):
    report = json.dumps({"status": "fail", "supported_claims": [], "unsupported_claims": [],
                         "citation_issues": [], "notes": "model"})
    drafts = A.answer_drafts(bundles)
    row = one(A.verification_reports(drafts, bundles, results_of(spark, {"q1": report}, REPORT)))
    assert (row["status"], row["mode"], row["failure_reason"], row["attempts"]) == (
        "pass_with_warnings", "deterministic_skip", "skipped_for_fallback_answer", 0)
    assert row["notes"] == A.FALLBACK_REPORT_NOTES
    assert A.verification_reports(drafts, bundles).where("query_id = 'q3'").count() == 0


def test_model_report_is_cleaned(spark, bundles):
    report = json.dumps({
        "status": "pass_with_warnings", "supported_claims": ["c1"],
        "unsupported_claims": [{"claim_id": "c1", "reason": "r"}, {"claim_id": "c9", "reason": "r"}],
        "citation_issues": [{"passage_id": "p2", "issue": "i"}, {"passage_id": "zz", "issue": "i"}],
        "notes": "n"})
    drafts = A.answer_drafts(bundles, results_of(spark, {"q1": json.dumps(GOOD)}))
    reports = A.verification_reports(drafts, bundles, results_of(spark, {"q1": report}, REPORT))
    row = one(reports)
    assert row["mode"] == "structured" and row["structured_success"]
    assert [u["claim_id"] for u in row["unsupported_claims"]] == ["c1"]
    assert [i["passage_id"] for i in row["citation_issues"]] == ["p2"]
    answer = one(A.final_responses(drafts, reports, bundles))
    assert answer["verification_warnings"] == [
        "1 claim(s) could not be fully verified.", "1 citation issue(s) detected.", "n"]
    assert answer["error"] is None and answer["final_answer"] == "Patience wins."
    assert [tuple(c) for c in answer["citations"]] == [
        ("p1", "wears down", "title p1", "Patience wears down stone.")]


@pytest.mark.parametrize("status", ["pass", "fail"])
def test_final_response_by_status(spark, bundles, status):
    report = json.dumps({"status": status, "supported_claims": [], "notes": "",
                         "unsupported_claims": [{"claim_id": "c1", "reason": "r"}],
                         "citation_issues": []})
    drafts = A.answer_drafts(bundles, results_of(spark, {"q1": json.dumps(GOOD)}))
    reports = A.verification_reports(drafts, bundles, results_of(spark, {"q1": report}, REPORT))
    row = one(A.final_responses(drafts, reports, bundles))
    assert row["verification_status"] == status and row["debug_url"] == "/queries/q1/retrieval-debug"
    if status == "pass":
        assert row["verification_warnings"] == [] and row["error"] is None
        assert row["confidence_notes"] == "sure" and len(row["citations"]) == 1
    else:
        assert (row["final_answer"], row["citations"], row["objections"]) == ("", [], [])
        assert row["verification_warnings"] == [
            "The answer could not be verified against the source text.", "Unsupported claims: 1", ""]
        assert "contained 1 unsupported claim(s)" in row["error"]


def test_overview_and_citations(spark, bundles):
    drafts = A.answer_drafts(bundles)
    reports = A.verification_reports(drafts, bundles)
    asked = spark.createDataFrame([("q1", "a?"), ("q3", "b?"), ("q9", "c?")],
                                  "query_id string, question string")
    got = {r["query_id"]: r for r in A.query_overview(asked, bundles, drafts, reports).collect()}
    assert got["q1"]["verification_status"] == "pass_with_warnings" and len(got["q1"]["citations"]) == 3
    assert (got["q9"]["verification_status"], got["q9"]["final_answer"], got["q9"]["citations"]) == (
        "unknown", "", [])
    stray = drafts.where("query_id = 'q1'").withColumn("supporting_citations", F.array(F.struct(
        F.lit("zz").alias("passage_id"), F.lit("q").alias("quote"))))
    row = A.citation_rows(stray, bundles).first()
    assert (row["section_title"], row["passage_text"]) == (None, "")


def test_latest_round_wins(spark):
    rows = spark.createDataFrame(
        [("q1", 1, "fail"), ("q1", 2, "pass"), ("q2", 1, "fail")], "query_id string, round int, status string")
    assert {tuple(r) for r in latest(rows, "round").collect()} == {("q1", 2, "pass"), ("q2", 1, "fail")}


def test_objections_may_be_texts_or_objects(values):
    assert values(A.objection_issues, ['["a", {"issue": "b"}]', "[]", "broken"]) == [
        ["a", "b"], [], None]


def test_prompts(spark, bundles):
    asked = spark.createDataFrame([("q1", "Why?")], "query_id string, question string")
    prompt = one(answer_prompts(asked, bundles))["prompt"]
    evidence = json.loads(prompt.split("Evidence Passages:\n")[1].split("\n\nInstructions")[0])
    assert evidence["query"] == "Why?" and [a["rank"] for a in evidence["anchors"]] == [1, 2, 3, 4]
    drafts = A.answer_drafts(bundles)
    check = one(verifier_prompts(asked, bundles, drafts))["prompt"]
    draft = json.loads(check.split("Answer Draft to Verify:\n")[1].split("\n\nInstructions")[0])
    assert draft["claims"][0]["claim_id"] == "fallback_c1"
    rows = spark.createDataFrame([("q1", 1, '{"x"', None), ("q1", 2, json.dumps(GOOD), None),
                                  ("q1", 3, None, "boom")], ATTEMPTS)
    fixes = correction_prompts(check_outputs(rows, ANSWER), answer_prompts(asked, bundles), ANSWER)
    got = fixes.collect()
    assert len(got) == 1 and got[0]["prompt"].endswith('Previous invalid output:\n{"x"')
    assert "Failure reason: json_parse" in got[0]["prompt"] and '"claim_id"' in got[0]["prompt"]


def test_failed_answers_get_a_second_round(spark, bundles):
    from groundsieve.plans.answering import answer

    weak = GOOD | {"claims": [GOOD["claims"][0] | {"supporting_passage_ids": []}]}
    first = results_of(spark, {"q1": json.dumps(weak), "q2": json.dumps(GOOD)})
    second = results_of(spark, {"q1": json.dumps(GOOD | {"final_answer": "Better."}),
                                "q2": json.dumps(weak)})
    once = answer(bundles, first)
    assert one(once.responses)["verification_status"] == "fail"
    twice = answer(bundles, first, second_answers=second)
    got = {r["query_id"]: (r["verification_status"], r["final_answer"])
           for r in twice.responses.collect()}
    assert got == {"q1": ("pass_with_warnings", "Better."), "q2": ("pass_with_warnings", "Patience wins."),
                   "q3": ("fail", "")}  # without evidence
    assert {r["query_id"]: r["round"] for r in twice.reports.collect()} == {"q1": 2, "q2": 1}
    still = answer(bundles, first, second_answers=first)
    assert one(still.responses)["verification_status"] == "fail" and one(still.drafts)["round"] == 2
