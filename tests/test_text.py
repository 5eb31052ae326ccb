import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import functions as F

from groundsieve.config import DEFAULT_EXPANSIONS, STOP_WORDS
from groundsieve.functions import text as T
from groundsieve.operators.lexical import prepare_questions


def plain_normalize(text):
    lines = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    joined = "\n".join(re.sub("[ \t]+", " ", x).strip() for x in lines)
    return re.sub("\n{3,}", "\n\n", joined).strip()


SUFFIX_RULES = [  # suffix test, least length, cut, tail
    (lambda w: w.endswith("ies"), 5, 3, "y"), (lambda w: w.endswith("ing"), 6, 3, ""),
    (lambda w: w.endswith("ed"), 5, 2, ""),
    (lambda w: re.search("(ch|sh|x|z|ss)es$", w), 5, 2, ""),
    (lambda w: w.endswith("s") and not w.endswith(("ss", "ses")), 5, 1, ""),
]


def plain_stem(word):
    if len(word) > 3:
        for test, least, cut, tail in SUFFIX_RULES:
            if test(word) and len(word) >= least:
                return word[:-cut] + tail
    return word


def plain_tokens(text, compat):
    words = re.findall("[a-z0-9]+", text.lower())
    if not compat:
        words = [w for w in words if w not in STOP_WORDS]
    return [s for s in map(plain_stem, words) if s not in STOP_WORDS]


@pytest.mark.parametrize("raw, clean", [
    ("a  b\t\tc", "a b c"),
    ("one\r\ntwo\rthree", "one\ntwo\nthree"),
    ("  x \n\n\n\n y  ", "x\n\ny"),
    ("cafe\u0301", "caf\u00e9"),
    ("a \n \t \n \n b", "a\n\nb"),
    (" pad \n\x1cend\x1f", "pad\nend"),
    ("", ""),
])
def test_normalize_text(values, raw, clean):
    assert values(T.normalize_text, [raw]) == [clean] == [plain_normalize(raw)]


def test_normalize_text_any_input_and_fixed_point(values):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="ab .\t\n\r\u0301e\u00e9 \x1c|#", max_size=40), min_size=30,
                    max_size=30))
    def check(texts):
        out = values(T.normalize_text, texts)
        assert out == [plain_normalize(t) for t in texts]
        assert values(T.normalize_text, out) == out

    check()


def test_normalize_question(values):
    assert values(T.normalize_question, ["  What\n\tis   it? ", "e\u0301 "]) == ["What is it?", "\u00e9"]


@pytest.mark.parametrize("compat", [False, True])
def test_tokens_match_the_rules(values, compat):
    parts = ["pari", "es", "box", "s", "ing", "ed", "ch", "ss", "z", "according", "anything", "The",
             "a1", "e", "str", "is", " ", "-", ", ", "é"]

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.sampled_from(parts), max_size=12).map("".join), min_size=60,
                    max_size=60))
    def check(texts):
        got = values(lambda c: T.lexical_tokens(c, compat), texts)
        assert got == [plain_tokens(t, compat) for t in texts]

    check()


def test_unstemmed_stop_words_only_go_by_default(values):
    text = "according to anything associated"
    assert values(T.lexical_tokens, [text]) == [[]]
    assert values(lambda c: T.lexical_tokens(c, True), [text]) == [["accord", "anyth", "associat"]]


def _query(spark, question, **options):
    rows = spark.createDataFrame([("q", question)], "query_id string, question string")
    return prepare_questions(rows, **options).first()


def test_expansion(spark):
    table = dict(DEFAULT_EXPANSIONS)
    row = _query(spark, "What is said about charity?", expansions=table)
    assert row["normalized_tokens"] == ["said", "charity"]
    assert row["expanded_terms"] == ["alm", "giv", "poor", "zakat"] or row["expanded_terms"] == [
        "alms", "giv", "poor", "zakat"]
    assert _query(spark, "charity", expansions=table, enabled=False)["expanded_terms"] == []
    # A term that is asked for already is not added again.
    assert "poor" not in _query(spark, "charity poor", expansions=table)["expanded_terms"]


def test_inflected_expansion_keys_fire_unless_compat(spark):
    table = {"fasting": ("ramadan",)}
    assert _query(spark, "fasting", expansions=table)["expanded_terms"] == ["ramadan"]
    assert _query(spark, "fasting", expansions=table, compat=True)["expanded_terms"] == []


def test_queries_are_stemmed_twice_only_under_compat(spark):
    assert _query(spark, "blessings")["search_terms"] == ["blessing"]
    assert _query(spark, "blessings", compat=True)["search_terms"] == ["bless"]


def test_token_count(values):
    assert values(T.token_count, ["", "  ", "a", " a b\nc "]) == [0, 0, 1, 3]


@pytest.mark.parametrize("text, strategy", [
    ("short\ntext", "paragraph"),
    ("\n".join(f"line {n}" for n in range(10)), "natural_units"),
    ("\n".join(f"line {n}" for n in range(10)) + "\n\nfooter\n", "natural_units"),
    ("First block of prose.\n\nSecond block of prose.\n\nThird block of prose.", "paragraph"),
    ("\n".join("x" * 300 for _ in range(5)), "paragraph"),
    ("", "paragraph"),
    ("a\r\nb c\x0bd", "natural_units"),
])
def test_infer_strategy(values, text, strategy):
    assert values(T.infer_passage_strategy, [text]) == [strategy]


def test_unit_reference(values):
    assert values(T.unit_reference, ["2|153|Seek help", "2|153", "a|1|x", "no", "2", "|1|x"]) == [
        "2|153", "2|153", None, None, None, None]


def test_quote_found(spark):
    rows = spark.createDataFrame([("abc", "b"), ("abc", "x"), ("abc", "")], "t string, q string")
    got = rows.select(T.quote_found(F.col("t"), F.col("q")).alias("y")).collect()
    assert [r["y"] for r in got] == [True, False, True]
