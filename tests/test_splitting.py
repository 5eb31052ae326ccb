import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from groundsieve.functions.spans import running_offsets
from groundsieve.operators import splitting as S

DOC = "document_id string, text string, sectioning_strategy string, passage_strategy string"


def split(spark, text, sections="paragraph", passages="natural_units", compat=False):
    rows = spark.createDataFrame([("d", text, sections, passages)], DOC)
    return S.split_documents(rows, compat)


def passages(spark, *args, **kw):
    rows = S.passages_table(split(spark, *args, **kw)).orderBy("passage_index").collect()
    return [(r["text"], r["start_offset"], r["end_offset"]) for r in rows]


def sections(spark, text, strategy):
    rows = S.sections_table(split(spark, text, strategy)).orderBy("order_index").collect()
    return [(r["section_type"], r["title"], r["start_offset"], r["end_offset"]) for r in rows]


def test_running_offsets_over_many_blocks(values):
    sizes = [(n * 7) % 11 for n in range(1500)]
    expected = [sum(sizes[:n]) for n in range(1500)]
    assert values(running_offsets, [sizes, [], [5]], "array<int>") == [expected, [], [0]]


def test_lines(spark):
    assert passages(spark, "Red fox.\n\nBlue jay.\nOld oak.") == [
        ("Red fox.", 0, 8), ("Blue jay.", 10, 19), ("Old oak.", 20, 28)]


def test_paragraph_offsets_are_exact_or_one_early(spark):
    text = "Red fox\nruns.\n\nBlue jay.\n\nOld oak."
    exact = [("Red fox\nruns.", 0, 13), ("Blue jay.", 15, 24), ("Old oak.", 26, 34)]
    early = [(t, s - 1 if s else s, e) for t, s, e in exact]
    assert passages(spark, text, passages="paragraph") == exact
    assert passages(spark, text, passages="paragraph", compat=True) == early


def test_sentence_groups(spark):
    text = "One. Two! Three? Four.\nFive. Six"
    assert passages(spark, text, passages="sentence_group") == [
        ("One. Two! Three?", 0, 16), ("Four. Five. Six", 17, 32)]
    # The second group is not verbatim in the text, so compat starts where the first one ended.
    assert passages(spark, text, passages="sentence_group", compat=True) == [
        ("One. Two! Three?", 0, 16), ("Four. Five. Six", 16, 31)]


def test_unknown_passage_strategy_fails(spark):
    with pytest.raises(Exception, match="unknown passage strategy: verse"):
        passages(spark, "text", passages="verse")


@pytest.mark.parametrize("strategy", ["natural_units", "paragraph", "sentence_group"])
def test_offsets_slice_back(spark, strategy):
    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="ab.!? \né\r\t", max_size=60), min_size=25, max_size=25))
    def check(texts):
        rows = spark.createDataFrame(
            [(str(n), t, "paragraph", strategy) for n, t in enumerate(texts)], DOC)
        out = S.split_documents(rows)
        whole = {r["document_id"]: r["text"] for r in out.select("document_id", "text").collect()}
        for r in S.passages_table(out).collect():
            piece = whole[r["document_id"]][r["start_offset"]:r["end_offset"]]
            if strategy == "sentence_group":
                piece = re.sub(r"(?<=[.!?])\s+", " ", piece)
            assert piece == r["text"] == r["normalized_text"] and piece.strip() == piece != ""
            assert r["token_count"] == len(piece.split())

    check()


def test_heading_kinds(spark):
    text = "lost preamble\n# Mark\nbody\nALL CAPS\n12) numbered item\nrest"
    assert sections(spark, text, "heading") == [
        ("heading", "# Mark", 14, 26), ("heading", "ALL CAPS", 26, 35),
        ("heading", "12) numbered item", 35, 57)]
    assert sections(spark, "no heading here", "heading") == [("document", None, 0, 15)]


def test_heading_matches_may_span_lines(spark):
    texts = ["ABC DEF\n\nGHI JKL\nbody", "#\n\nTitle\nbody", "A, B\nXYZ: 12\n\n9. abc\nend"]
    pattern = re.compile(r"^(#{1,4}\s+.+|[A-Z][A-Z\s\d:,.-]{3,}|^\d+[\.\)]\s+.{3,})$", re.M)
    for text in texts:
        starts = [m.start() for m in pattern.finditer(text)]
        titles = [m.group().strip() for m in pattern.finditer(text)]
        got = sections(spark, text, "heading")
        assert [(t, s) for _, t, s, _ in got] == list(zip(titles, starts))
        assert [e for *_, e in got] == starts[1:] + [len(text)]


def test_paragraph_sections_hold_ten(spark):
    text = "\n\n".join(f"para {n}" for n in range(23))
    got = sections(spark, text, "paragraph")
    assert [g[0] for g in got] == ["paragraph_group"] * 3
    for n, (_, _, start, end) in enumerate(got):
        assert text[start:end] == "\n\n".join(f"para {i}" for i in range(n * 10, min(23, n * 10 + 10)))
    assert sections(spark, "", "paragraph") == [("paragraph_group", None, 0, 0)]
    assert sections(spark, "x", "no such strategy") == [("paragraph_group", None, 0, 1)]


def test_explicit_sections_are_clamped_and_keep_their_number(spark):
    bounds = [("A", None, 0, 5, None), ("past", None, 99, 120, None), ("B", "part", 5, 99, {"k": "v"})]
    rows = spark.createDataFrame(
        [("d", "12345\nline", "explicit", "natural_units", bounds)],
        DOC + f", section_boundaries {S.BOUNDARIES}")
    out = S.split_documents(rows)
    got = S.sections_table(out).orderBy("order_index").collect()
    assert [(r["title"], r["section_type"], r["order_index"], r["start_offset"], r["end_offset"],
             r["metadata"]) for r in got] == [
        ("A", "chapter", 0, 0, 5, {}), ("B", "part", 2, 5, 10, {"k": "v"})]
    got = S.passages_table(out).orderBy("passage_index").collect()
    assert [(r["text"], r["section_title"], r["start_offset"]) for r in got] == [
        ("12345", "A", 0), ("line", "B", 6)]


def test_empty_document_has_no_passages(spark):
    assert passages(spark, " \n\n ") == []


def plain_windows(rows, radius):
    """(anchor, low, high, ids) by looking at every pair."""
    out = set()
    for doc, i in rows:
        mine = [j for d, j in rows if d == doc]
        out.add((doc, i, max(i - radius, min(mine)), min(i + radius, max(mine)),
                 tuple(j for j in sorted(mine) if abs(i - j) <= radius)))
    return out


@pytest.mark.parametrize("radius, block", [(1, 2), (2, 2), (3, 4), (2, 1024), (5, 1)])
def test_windows_of_gapped_passages(spark, radius, block):
    rows = [("a", i) for i in range(30) if i % 4 and i not in (9, 10, 11)] + [("b", 7), ("c", 0), ("c", 99)]
    table = spark.createDataFrame(
        [(d, f"{d}-{i}", i, f"t{i}", f"n{i}") for d, i in rows],
        "document_id string, passage_id string, passage_index int, text string, normalized_text string")
    got = S.context_windows(table.repartition(3), radius, block).collect()
    assert {(r["document_id"], r["anchor_passage_index"], r["start_passage_index"],
             r["end_passage_index"], tuple(int(i.split("-")[1]) for i in r["included_passage_ids"]))
            for r in got} == plain_windows(rows, radius)
    assert len(got) == len(rows)
    for r in got:
        ids = [i.split("-")[1] for i in r["included_passage_ids"]]
        assert r["text"] == " ".join("t" + i for i in ids)
        assert r["normalized_text"] == " ".join("n" + i for i in ids)


def test_windows_in_row_equal_windows_by_join(spark, proverbs):
    out = S.split_documents(proverbs)
    columns = ["anchor_passage_id", "start_passage_index", "end_passage_index",
               "included_passage_ids", "text"]
    for radius in (1, 2, 50):
        left = S.windows_table(out, radius).select(columns).collect()
        right = S.context_windows(S.passages_table(out), radius).select(columns).collect()
        assert sorted(map(str, left)) == sorted(map(str, right)) and len(left) == 20


def test_splitting_needs_no_shuffle(spark, proverbs):
    out = S.split_documents(proverbs)
    for table in (S.passages_table(out), S.sections_table(out), S.windows_table(out)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan.replace("windows", "")


def test_ingest_of_a_stream(spark, tmp_path):
    from groundsieve.plans.ingest import ingest

    spark.createDataFrame([("s", "one\ntwo\nthree", "paragraph", "natural_units")], DOC).write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema(DOC).parquet(str(tmp_path / "in"))
    query = (ingest(stream).passages.writeStream.format("memory").queryName("ingested")
             .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination(60)
    assert spark.table("ingested").select(F.max("passage_index")).first()[0] == 2
