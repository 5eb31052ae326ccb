"""Text normalisation, tokenising and small text predicates, as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from groundsieve.config import STOP_WORDS

# Whitespace as Unicode has it plus the four ASCII separators 1C-1F.
SPACE = r"[\s\x1c-\x1f]"
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# White space but line feeds, spelled out: the same characters as SPACE, without Unicode look-ups.
_RARE_BLANK = r"\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = rf" \t\r{_RARE_BLANK}"
# The stop words that stemming may change; all others can be looked up after it.
INFLECTED_STOP = tuple(w for w in STOP_WORDS if len(w) > 3 and w.endswith(("ing", "ed", "s")))
_INFLECTED_STOP = r"\b(?:" + "|".join(INFLECTED_STOP) + r")\b"


@F.pandas_udf(StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Characters below U+0300 never change, so only rows that
    hold a higher one are sent to Python; the others pass it as nulls."""
    suspect = F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)
    return F.coalesce(_nfc_batch(suspect), text)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def normalize_text(text: Column) -> Column:
    """NFC, unix line ends, single blanks, stripped lines, at most one empty line in a row."""
    out = _where(nfc(text), lambda t: F.contains(t, F.lit("\r")), r"\r\n?", "\n")
    out = _where(out, lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), r"[ \t]+", " ")
    out = _where(
        out, lambda t: F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\n ")) | t.rlike(f"[{_RARE_BLANK}]"),
        rf"[{_BLANK}]+\n[{_BLANK}]*|\n[{_BLANK}]+", "\n")
    out = _where(out, lambda t: F.contains(t, F.lit("\n\n\n")), r"\n{3,}", "\n\n")
    return strip(out)


def _where(text: Column, needed: Callable[[Column], Column], pattern: str, new: str) -> Column:
    """The text with a replacement made, looked for only where a cheaper test finds it ``needed``."""
    return F.transform(F.array(text), lambda t: F.when(needed(t), F.regexp_replace(t, pattern, new)).otherwise(t))[0]


def normalize_question(text: Column) -> Column:
    return strip(F.regexp_replace(nfc(text), rf"(?U){SPACE}+", " "))


def light_stem(words: Column) -> Column:
    """Strips one plain English suffix from every word of a blank-separated lower-case string.

    Working on the whole string keeps the stemmer to two regex passes; each
    word is hit by at most one suffix, and a word made by the first pass ends
    in ``y``, which the second one leaves alone.
    """
    out = F.regexp_replace(words, r"ies\b(?<=[a-z0-9]{5})", "y")
    return F.regexp_replace(
        out,
        r"ing\b(?<=[a-z0-9]{6})|ed\b(?<=[a-z0-9]{5})"
        r"|es\b(?<=[a-z0-9](?:ch|sh|ss)es|[a-z0-9]{2}[xz]es)"
        r"|s\b(?<=[a-z0-9]{5})(?<!ss|ses)",
        "",
    )


def lexical_tokens(text: Column, compat: bool = False) -> Column:
    """Stemmed ASCII tokens without stop words.

    A word is dropped if it or its stem is a stop word; ``compat`` looks at the
    stem alone, so unstemmed entries of the stop list never match.
    """
    words = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")
    if not compat:
        words = F.regexp_replace(words, _INFLECTED_STOP, "")
    stems = F.split(light_stem(words), " ")  # a plain blank is no regex; empty words go below
    return F.filter(stems, lambda stem: ~stem.isin("", *STOP_WORDS))


def blank_tokens(text: Column) -> Column:
    """Tokens between runs of whitespace."""
    # Most texts have plain blanks only, and a single character to split on is no regex.
    other = text.rlike(rf"[\t\n\r{_RARE_BLANK}]")
    return F.array_remove(F.when(other, F.split(text, rf"[\n{_BLANK}]+")).otherwise(F.split(text, " ")), "")


def token_count(text: Column) -> Column:
    """The number of ``blank_tokens``; where single blanks stand between words, the blanks are counted."""
    blank = F.lit(" ")
    plain = ~(text.rlike(rf"[\t\n\r{_RARE_BLANK}]") | F.contains(text, F.lit("  ")) | F.startswith(text, blank)
              | F.endswith(text, blank) | (text == ""))
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, blank, F.lit("")))
    return F.when(plain, blanks + 1).otherwise(F.size(blank_tokens(text)))


def expand_terms(tokens: Column, expansions: dict, compat: bool = False) -> Column:
    """Stems of the expansion terms of every token that are not tokens themselves.

    Keys are stemmed so that they meet the stemmed tokens; ``compat`` keeps
    them raw, and inflected keys then never fire.
    """
    if not expansions:
        return F.array().cast("array<string>")
    table = F.array(*[
        F.struct(
            (F.lit(key) if compat else light_stem(F.lit(key))).alias("key"),
            F.array(*[light_stem(F.lit(term.lower())) for term in terms]).alias("terms"),
        )
        for key, terms in expansions.items()
        if terms
    ])
    extra = F.flatten(F.transform(tokens, lambda token: F.flatten(F.transform(
        F.filter(table, lambda entry: entry["key"] == token), lambda entry: entry["terms"]))))
    return F.array_except(F.array_remove(extra, ""), tokens)


def infer_passage_strategy(text: Column) -> Column:
    """``natural_units`` for texts that are mostly one unit per short line, else ``paragraph``."""
    raw = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    # A closing line break ends the last line, it does not open another.
    lines = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    sizes = F.transform(lines, lambda line: F.length(strip(line)))

    def judged(sizes: Column) -> Column:
        total, used = F.size(sizes), F.size(F.array_remove(sizes, 0))
        blank = total - used
        mean_length = F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n) / used
        line_like = (
            (used >= 3)
            & (blank <= F.greatest(F.lit(3), F.floor(total * F.lit(0.02))))
            & (blank / total <= 0.2)
            & (used / total >= 0.85)
            & (mean_length < 220)
        )
        return F.when(line_like, "natural_units").otherwise("paragraph")

    return F.transform(F.array(sizes), judged)[0]


def unit_reference(text: Column) -> Column:
    """``chapter|unit`` from the start of a ``chapter|unit|text`` passage, else null."""
    parts = F.split(text, r"\|", 3)
    chapter, unit = F.get(parts, 0), F.get(parts, 1)
    return F.when(
        chapter.rlike(r"\A\p{Nd}+\z") & unit.rlike(r"\A\p{Nd}+\z"), F.concat_ws("|", chapter, unit)
    )


def quote_found(passage_text: Column, quote: Column) -> Column:
    """True if the quote stands verbatim in the passage; an empty quote always does."""
    return (quote == "") | F.contains(passage_text, quote)
