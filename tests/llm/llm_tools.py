from __future__ import annotations

import random

import pytest

# Columns that operators use inside, to clash with them.
CLASHING = ("score", "unit", "bands", "key", "row", "pattern", "h1", "line", "doc", "piece", "start", "label",
            "length", "words", "tie", "part", "kept", "n_words", "class", "k1", "posterior", "_dropped", "leaked", "number")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def sentence(rng: random.Random, words: int) -> str:
    letters = "abcdefghiklmnoprstuv"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words)).capitalize() + "."


def prose(rng: random.Random, lines: int, words: int = 14) -> str:
    return "\n".join(sentence(rng, words) for _ in range(lines))


def documents(spark, rows):
    """A document table of (doc_id, text) with extra columns whose names clash."""
    full = [(i, t, "en", "src", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and blank texts, a long text, repeated rows, one id twice."""
    rng = random.Random(5)
    story = prose(rng, 6)
    return [
        (1, story), (1, story), (2, prose(rng, 4)), (2, prose(rng, 3)), (3, None), (4, ""), (5, " \t\n \x0b"),
        (6, "one two"), (7, story), (8, prose(rng, 700)), (None, prose(rng, 3)), (None, None), (None, story),
        (9, "É̈ l'été <|endoftext|> 東京 ٣٤ it's DON'T"), (10, "\n\n" + story + "\n" + story.split("\n")[0]),
        (11, "word " * 300), (12, "!!! ??? ..."), (-13, prose(rng, 2))]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return documents(spark, messy_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
