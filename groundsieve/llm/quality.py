"""Quality rules as weak supervision, in built-in functions only.

Every rule looks at a few measures of a text and votes for a good text (1), for
a bad one (-1) or abstains (0). How often each rule errs on good texts and finds
each kind of bad ones is not set by hand: expectation maximisation estimates it,
with the share of each kind, from the votes of all documents. A document's quality
is then the posterior probability that it is good given its votes.

All passes over texts stay in the JVM. Documents with the same votes are alike
to the model, so it is fitted on a table of vote patterns with their counts: at
most 3 to the power of the number of rules, whatever the number of documents.

Defined results: a null or blank text has no words, which fails the base check;
measures, votes and posteriors depend on the text alone, so repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.common import texts_of
from groundsieve.sources.staging import stage

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


@dataclass(frozen=True)
class EmOptions:
    steps: int = 2000
    tolerance: float = 1e-9
    false_alarms: float = 0.05  # expected share of good texts that a rule errs on
    alarm_weight: float = 0.02  # of this expectation, as a share of all rows
    unseen: float = 0.001      # expectation that a rule finds nothing in other rules' kinds, as a share of all rows
    threshold: float = 0.5     # posterior from which a text is kept


def default_rules() -> list[Rule]:
    """The middle ground between the two conditions of a rule is where it abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    return [
        Rule("symbols", F.col("n_symbols") <= 0.02 * words, F.col("n_symbols") > 0.2 * words),
        Rule("capitals", F.col("n_capitals") <= 0.1 * chars, F.col("n_capitals") > 0.4 * chars),
        Rule("shouting", F.col("n_exclamations") <= 0.1 * words, F.col("n_exclamations") > 0.5 * words),
        Rule("repeats", F.col("n_repeat_words") <= 0.05 * words, F.col("n_repeat_words") > 0.4 * words),
        Rule("variety", F.col("n_distinct") >= 0.4 * words, F.col("n_distinct") < 0.3 * words),
        Rule("lines", F.col("n_dup_lines") <= 0.1 * lines, F.col("n_dup_lines") > 0.5 * lines),
        Rule("word_length", mean.between(3, 8), (mean < 2) | (mean > 14)),
    ]


def _count_of(characters: str) -> Column:
    return F.length("text") - F.length(F.translate("text", characters, ""))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and measures of each text; see ``default_rules`` for what uses them."""
    rows = texts_of(docs, key, text).select(F.col(key), F.col(text).alias("text"))
    return with_measures(rows).drop("text")


def with_measures(rows: DataFrame) -> DataFrame:
    """The rows, with a ``text`` that is not null, and the measures beside them."""
    kept = [F.col(c) for c in rows.columns]
    trimmed = F.btrim("text", F.lit(SPACE))
    split = rows.select(
        *kept,
        F.split(trimmed, r"[\x20\x09-\x0D]+").alias("_words"),
        F.filter(F.split("text", "\n"), lambda l: F.btrim(l, F.lit(SPACE)) != "").alias("_lines"))
    n_words = F.when(F.element_at("_words", 1) == "", 0).otherwise(F.size("_words")).cast("long")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]))
    counted = split.select(
        *kept, n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        _count_of(_UPPER).cast("long").alias("n_capitals"),
        _count_of("!").cast("long").alias("n_exclamations"),
        F.when(F.size("_words") >= WINDOW, windows).alias("_windows"))
    # Windows that occur twice, by sorting them next to each other: their places in order.
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = counted.select(*[c for c in counted.columns if c != "_windows"], F.when(
        repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).alias("_sorted"))
    own = [c for c in placed.columns if c != "_sorted"]
    same = F.filter("_sorted", lambda x, n: (F.get(F.col("_sorted"), n - 1)["h"] == x["h"])
                    | (F.get(F.col("_sorted"), n + 1)["h"] == x["h"]))
    places = placed.select(*own, F.array_sort(F.transform(same, lambda x: x["i"])).alias("_places"))
    # Each such window covers words up to the next one's start, eight at most.
    steps = F.zip_with("_places", F.slice("_places", 2, F.greatest(F.size("_places") - 1, F.lit(0))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return places.select(*own, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_votes(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """The measured rows and ``pattern``: the votes as one number in base three."""
    pattern = F.lit(0)
    for rule in rules:
        pattern = pattern * 3 + (rule.vote() + 1)
    return measured.withColumn("pattern", pattern)


def votes_of(pattern: int, rules: int) -> list[int]:
    out = []
    for _ in range(rules):
        pattern, vote = divmod(pattern, 3)
        out.append(vote - 1)
    return out[::-1]


def fit_patterns(counts: dict[int, int], rules: int, options: EmOptions = EmOptions()) -> dict[int, float]:
    """The posterior probability of a good text for each vote pattern.

    Expectation maximisation of a latent class model: one class of good texts and
    one kind of bad text for each rule, the kind that this rule sees. The kinds are tied:
    a rule's false alarms are as frequent in every kind as among good texts, and
    come on top of what it finds there. So the agreement of the rules tells
    errors from findings: votes that fall on bad texts of other kinds as often as
    on good ones are errors, votes that avoid them are a kind of their own, and
    votes that meet others' share a kind with them. That a rule abstains says nothing.

    Priors are shares of all rows, so only the proportions of the patterns count. Where
    nothing but one rule ever speaks against a text, its votes are errors up to
    about the expected share of false alarms.
    """
    if not counts:
        return {}
    tiny = 1e-12
    patterns = sorted(counts)
    votes = np.array([votes_of(p, rules) for p in patterns])
    against, cast_good = (votes == -1).astype(float), (votes == 1).astype(float)
    share = np.array([counts[p] for p in patterns], float) / sum(counts.values())
    number = against.sum(1, keepdims=True)
    # Of each pattern in the classes, good first: every further vote against halves the first guess.
    good = 0.5 ** number
    parts = np.hstack([good, np.where(number > 0, (1 - good) * against / np.maximum(number, 1), 0.0)])
    alarms = np.full(rules, options.false_alarms)
    found = np.full((rules, rules), 0.5)  # by the rule (column) in each kind (row)
    np.fill_diagonal(found, 1.0)
    unseen = options.unseen * (1 - np.eye(rules))
    before = -math.inf
    for _ in range(options.steps):
        mass = (share[:, None] * parts).T
        bad, fine = mass @ against, mass @ cast_good
        either = 1 - (1 - alarms) * (1 - found)
        alarms_now = (options.alarm_weight * options.false_alarms + bad[0] + (bad[1:] * alarms / either).sum(0)) / (
            options.alarm_weight + bad.sum(0) + fine.sum(0))
        cast = bad[1:] + fine[1:] + unseen
        found = np.where(cast > 0, bad[1:] * found / either / np.where(cast > 0, cast, 1), found)
        alarms = alarms_now
        rates = np.clip(np.vstack([alarms, 1 - (1 - alarms) * (1 - found)]), tiny, 1 - tiny)
        logs = np.log(np.maximum(mass.sum(1), tiny)) + against @ np.log(rates).T + cast_good @ np.log(1 - rates).T
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        parts = np.exp(logs - total)
        likelihood = float(share @ total[:, 0])
        if abs(likelihood - before) <= options.tolerance * abs(likelihood):
            break
        before = likelihood
    return {p: float(x) for p, x in zip(patterns, parts[:, 0])}


def pattern_posteriors(voted: DataFrame, rules: int, options: EmOptions = EmOptions()) -> DataFrame:
    """pattern and posterior, for the patterns that occur (at most 3 ** rules rows)."""
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    rows = sorted(fit_patterns(counts, rules, options).items())
    return voted.sparkSession.createDataFrame(rows, "pattern int, posterior double")


def judge(voted: DataFrame, rules: int, options: EmOptions = EmOptions()) -> DataFrame:
    """The voted rows with ``posterior``, ``base_failed`` and ``kept``."""
    posteriors = pattern_posteriors(voted, rules, options)
    return voted.join(F.broadcast(posteriors), "pattern", "left").withColumn(
        "base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= options.threshold))


def quality_table(docs: DataFrame, options: EmOptions = EmOptions()) -> DataFrame:
    """Measures, verdict and posterior of every document."""
    rules = default_rules()
    voted = stage(with_votes(measures(docs), rules), "quality-votes")
    return judge(voted, len(rules), options).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, options: EmOptions = EmOptions()) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    rules, own = default_rules(), docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))
    voted = stage(with_votes(with_measures(rows), rules).select(
        "row", "n_words", "n_repeat_words", "pattern"), "quality-votes")
    return judge(voted, len(rules), options).where("kept").select("row.*")
