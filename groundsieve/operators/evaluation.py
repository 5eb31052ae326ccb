"""Scoring retrieval and grounding: per question, per run, per experiment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions import automaton
from groundsieve.functions.ranked import (
    CUTOFFS, failure_type, hit_at, lost_in_fusion, missed_by_both, ordered_ids, precision_at,
    recall_at, reciprocal_rank,
)
from groundsieve.functions.text import blank_tokens, quote_found, unit_reference
from groundsieve.sources.staging import bounded, stage

# What runs in the workers travels with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(automaton)

_NO_IDS = "array<string>"


def mean(value: Column, digits: int = 4) -> Column:
    """Rounded mean of the values there are; 0 without any."""
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits)


def _share(condition: Column) -> Column:
    return mean(F.coalesce(condition, F.lit(False)).cast("double"))


# Gold -----------------------------------------------------------------------

def resolve_references(passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Gold unit references to passage ids: wanted(query_id, refs) gives
    query_id, expected_ids in the order of the references.

    The first passage by id that starts with a reference stands for it. The
    references asked for are few against the corpus, so passages are cut to
    them before the first one is looked for.
    """
    asked = wanted.select("query_id", F.posexplode("refs").alias("place", "ref"))
    refs = asked.select("ref").distinct()
    units = passages.select("passage_id", unit_reference(F.col("text")).alias("ref")).where(
        F.col("ref").isNotNull())
    first = units.join(F.broadcast(refs) if bounded(refs) else refs, "ref", "left_semi").groupBy(
        "ref").agg(F.min("passage_id").alias("passage_id"))
    found = asked.join(first, "ref").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "passage_id"))).alias("found"))
    return wanted.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("found.passage_id", F.array().cast(_NO_IDS)).alias("expected_ids"))


def locate_quotes(passages: DataFrame, quotes: DataFrame) -> DataFrame:
    """query_id and passage_id of every passage that holds the quote of quotes(query_id, quote).

    Containment is no equality, but the inner words of a quote stand in the
    passage as whole words: the longest of them is the join key and the quote
    itself is compared only where that word occurs. A quote of fewer than
    three words has no inner word and is compared with every passage through
    an empty key.
    """
    words = blank_tokens(F.col("quote"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = quotes.where("quote <> ''").select(
        "query_id", "quote", F.coalesce(longest["w"], F.lit("")).alias("word"))
    keys = F.array_union(blank_tokens(F.col("normalized_text")), F.array(F.lit("")))
    asked = keyed.select("word").distinct()
    small = bounded(keyed)
    spread = passages.select("passage_id", "normalized_text", F.explode(keys).alias("word"))
    if small:
        found = spread.join(F.broadcast(asked), "word", "left_semi").join(F.broadcast(keyed), "word")
    else:
        # A frequent key would fill one task: split it by passage.
        salt = F.pmod(F.xxhash64("passage_id"), F.lit(32))
        copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        found = spread.withColumn("salt", salt).join(copies, ["word", "salt"])
    return found.where(quote_found(F.col("normalized_text"), F.col("quote"))).select(
        "query_id", "passage_id")


def locate_many_quotes(passages: DataFrame, quotes: DataFrame, block_quotes: int = 100_000,
                       block_chars: int = 16_000_000) -> DataFrame:
    """The pairs of ``locate_quotes``, each once, for any number of quotes of any length.

    The distinct quotes go out in blocks of bounded size, each as one automaton that finds all of
    its quotes in one pass over a text. Passages are read where they lie; nothing but
    hits is shuffled, so no word and no passage that holds many quotes is a hot key.
    """
    asked = stage(quotes.where("quote <> ''").select("query_id", "quote").distinct(), "asked_quotes")
    sizes = asked.select("quote").distinct().agg(F.count("*").alias("n"), F.sum(F.length("quote")).alias("chars")).first()
    blocks = max(1, -(-sizes["n"] // block_quotes), -(-(sizes["chars"] or 0) // block_chars))
    # A quote's number is a hash of 64 bits.
    numbered = asked.select("query_id", "quote", F.xxhash64("quote").alias("number"),
                            F.pmod(F.xxhash64("quote", F.lit(1)), F.lit(blocks)).alias("block"))
    texts = passages.select(F.col("passage_id").cast("string").alias("passage_id"), "normalized_text")
    found = None
    for block in range(blocks):
        part = [(r["number"], r["quote"]) for r in numbered.where(F.col("block") == block).select(
            "number", "quote").distinct().collect()]
        hits = texts.mapInArrow(_finder(passages.sparkSession.sparkContext.broadcast(part)), "passage_id string, number long")
        found = hits if found is None else found.unionByName(hits)
    askers = numbered.select("number", "query_id")
    return found.join(F.broadcast(askers) if bounded(askers) else askers, "number").select("query_id", "passage_id").distinct()


def _finder(quotes):
    name = uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automaton.automaton_of(name, quotes.value)
        for batch in batches:
            yield automaton.found_quotes(held, batch)

    return find


def gather_ids(pairs: DataFrame, name: str = "expected_ids") -> DataFrame:
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("passage_id")).alias(name))


# Retrieval ------------------------------------------------------------------

def retrieval_metrics(
    rows: DataFrame, retrieved: str = "retrieved_ids", compat: bool = False,
    ks: tuple = CUTOFFS,
) -> DataFrame:
    """Adds hit, recall and precision at each k and mrr to rows with retrieved,
    expected and (optional) alternative ids.

    A question without gold says nothing about retrieval, so its metrics are
    null; ``compat`` gives it recall 1 and 0 elsewhere.
    """
    none = F.array().cast(_NO_IDS)
    expected = F.coalesce("expected_ids", none)
    if "alternative_ids" in rows.columns:
        expected = F.array_union(expected, F.coalesce("alternative_ids", none))
    rows = rows.withColumn("relevant_ids", F.array_distinct(expected))
    got, relevant = F.coalesce(retrieved, none), F.col("relevant_ids")
    judged = F.lit(True) if compat else F.size(relevant) > 0
    metrics = {}
    for k in ks:
        metrics[f"hit_at_{k}"] = hit_at(got, relevant, k)
        metrics[f"recall_at_{k}"] = recall_at(got, relevant, k)
        metrics[f"precision_at_{k}"] = precision_at(got, relevant, k)
    metrics["mrr"] = reciprocal_rank(got, relevant)
    return rows.withColumns({name: F.when(judged, value) for name, value in metrics.items()})


def evaluate_bundles(items: DataFrame, bundles: DataFrame, compat: bool = False) -> DataFrame:
    """Eval items with the ids their bundle holds and the metrics over them.

    retrieved_ids are the anchors followed by their windows; anchor_hit_at_5
    and anchor_mrr look at the anchors alone. An item without a bundle has
    nothing retrieved and an error.
    """
    rows = items.join(bundles.select("query_id", "anchors"), "query_id", "left")
    none = F.array().cast(_NO_IDS)
    rows = rows.select(
        *items.columns,
        F.coalesce(ordered_ids(F.col("anchors")), none).alias("retrieved_ids"),
        F.coalesce(F.transform("anchors", lambda a: a["passage_id"]), none).alias("anchor_ids"),
        F.when(F.col("anchors").isNull(), "no evidence bundle").alias("error"),
    )
    scored = retrieval_metrics(rows, compat=compat)
    judged = F.lit(True) if compat else F.size("relevant_ids") > 0
    return scored.withColumns({
        "anchor_hit_at_5": F.when(judged, hit_at(F.col("anchor_ids"), F.col("relevant_ids"), 5)),
        "anchor_mrr": F.when(judged, reciprocal_rank(F.col("anchor_ids"), F.col("relevant_ids"))),
    })


def grounding_metrics(drafts: DataFrame, reports: DataFrame, bundles: DataFrame,
                      compat: bool = False) -> DataFrame:
    """Per draft: share of citations that are in the bundle, share of
    supported claims (both 1 if there are none), open claims and status. A draft
    without a report (there was no evidence for it) keeps its row; what a report
    would tell is null there.

    Citations are counted as the model gave them; ``compat`` counts those left
    after cleaning, all of which are valid by then.
    """
    cited = (
        F.transform("supporting_citations", lambda c: c["passage_id"]) if compat
        else F.col("raw_citations")
    )
    rows = drafts.withColumn("cited", cited).select("query_id", "cited").join(
        reports.select("query_id", "status", "supported_claims", "unsupported_claims"), "query_id", "left"
    ).join(bundles.select("query_id", F.col("anchors.passage_id").alias("known")), "query_id", "left")
    valid = F.size(F.filter("cited", lambda i: F.coalesce(F.array_contains("known", i), F.lit(False))))
    good, bad = F.size("supported_claims"), F.size("unsupported_claims")
    return rows.select(
        "query_id",
        F.when(F.size("cited") == 0, 1.0).otherwise(valid / F.size("cited"))
        .alias("citation_validity_rate"),
        F.when(good + bad == 0, 1.0).otherwise(good / (good + bad)).alias("claim_support_rate"),
        bad.alias("unsupported_claim_count"), F.col("status").alias("verifier_status"),
    )


def summarize_run(results: DataFrame, by: tuple = ()) -> DataFrame:
    """Run means over the items without error, and counts of total, successful,
    failed and judged items. Grounding means appear if the columns are there."""
    fine = F.col("error").isNull()

    def avg(name: str, digits: int = 4) -> Column:
        return F.round(F.avg(F.when(fine, F.col(name))), digits).alias(name)

    aggregates = [
        F.count("*").alias("total"), F.count_if(fine).alias("successful"),
        F.count_if(~fine).alias("failed"),
        F.count_if(fine & (F.size("relevant_ids") > 0)).alias("n_with_gold"),
        *[avg(m) for m in ("hit_at_5", "hit_at_10", "hit_at_20", "recall_at_10",
                           "precision_at_10", "mrr")],
    ]
    if "claim_support_rate" in results.columns:
        aggregates += [
            avg("citation_validity_rate"), avg("claim_support_rate"),
            F.round(F.avg(F.when(fine, F.col("unsupported_claim_count"))), 2)
            .alias("avg_unsupported_claims"),
        ]
    return results.groupBy(*by).agg(*aggregates)


# Model runs -----------------------------------------------------------------

def first_ids(rank: str, top_k: int = 10) -> Column:
    """Aggregate: the passage ids of the first ``top_k`` ranks in order; rows without a rank stay out."""
    item = F.struct(F.col(rank).alias("place"), "passage_id")
    found = F.array_sort(F.collect_list(F.when(F.col(rank) < top_k, item)))
    return F.transform(found, lambda i: i["passage_id"])


def stage_ids(merged: DataFrame, reranked: DataFrame, top_k: int = 10,
              by: tuple = ("query_id",)) -> DataFrame:
    """lexical_ids, dense_ids, merged_ids and reranked_ids of every query."""
    before = merged.groupBy(*by).agg(
        first_ids("rank_lexical", top_k).alias("lexical_ids"),
        first_ids("rank_dense", top_k).alias("dense_ids"),
        first_ids("rank_hybrid", top_k).alias("merged_ids"))
    after = reranked.groupBy(*by).agg(first_ids("rank_rerank", top_k).alias("reranked_ids"))
    return before.join(after, list(by), "left")


def classify_failures(items: DataFrame, ids: DataFrame, top_k: int = 10,
                      by: tuple = ("query_id",)) -> DataFrame:
    """Hits, failure flag and failure type of items(query_id, expected_ids).

    failure_type tests a lexical miss before all other reasons and so hides
    them; miss_both and fusion_miss tell them apart.
    """
    rows = items.join(ids, list(by), "left")
    none = F.array().cast(_NO_IDS)
    expected = F.coalesce("expected_ids", none)
    lexical, dense, merged, final = (
        F.coalesce(c, none) for c in ("lexical_ids", "dense_ids", "merged_ids", "reranked_ids"))
    kind = failure_type(expected, lexical, dense, merged, final, top_k)
    hit = hit_at(final, expected, 10) > 0
    failed = (F.size(expected) > 0) & ~hit
    return rows.select(
        *items.columns, final.alias("retrieved_ids"),
        (hit_at(final, expected, 5) > 0).alias("hit_at_5"), hit.alias("hit_at_10"),
        failed.alias("failure"), F.when(failed, kind).alias("failure_type"),
        missed_by_both(expected, lexical, dense, top_k).alias("miss_both"),
        lost_in_fusion(expected, lexical, dense, merged, top_k).alias("fusion_miss"),
    )


def failure_histogram(results: DataFrame, by: tuple = ()) -> DataFrame:
    return results.where("failure").groupBy(
        *by, F.coalesce("failure_type", F.lit("unknown")).alias("failure_type")).count()


def summarize_model_run(results: DataFrame, by: tuple = (), generation: bool = True) -> DataFrame:
    """One row per run: hit and failure rates and, with generation, the rates of
    fallbacks, valid output, retries and repairs.

    Needs the columns of ``classify_failures`` plus error and, as structs with
    fallback_used, structured_success, attempts, repair_attempted and
    repair_succeeded, ``answer`` and ``verifier`` (null where a step was skipped).
    """
    aggregates = [
        F.count("*").alias("total_queries"), F.count_if(F.col("error").isNotNull()).alias("error_count"),
        _share(F.col("hit_at_5")).alias("hit_at_5"), _share(F.col("hit_at_10")).alias("hit_at_10"),
        F.count_if("failure").alias("failure_count"),
    ]
    nothing = F.lit(None)
    steps = ("answer", "verifier")

    def field(step: str, name: str) -> Column:
        return F.col(f"{step}.{name}")

    def retries(step: str) -> Column:
        # greatest skips nulls, so a skipped step has to be kept out by hand.
        return F.when(F.col(step).isNotNull(), F.greatest(field(step, "attempts") - 1, F.lit(0)))

    def total(name: str) -> Column:
        return F.count_if(field("answer", name)) + F.count_if(field("verifier", name))

    used = F.count("answer") + F.count("verifier")
    spent = F.sum(F.coalesce(retries("answer"), F.lit(0)) + F.coalesce(retries("verifier"), F.lit(0)))
    figures = {
        "fallback_count": F.count_if(field("answer", "fallback_used")),
        "fallback_rate": _share(field("answer", "fallback_used")),
        "verifier_fallback_count": F.count_if(field("verifier", "fallback_used")),
        "verifier_fallback_rate": _share(field("verifier", "fallback_used")),
        "schema_success_rate": _share(
            field("answer", "structured_success") & field("verifier", "structured_success")),
        "answer_schema_success_rate": _share(field("answer", "structured_success")),
        "verifier_schema_success_rate": _share(field("verifier", "structured_success")),
        "average_retries_used": F.round(F.coalesce(F.try_divide(spent, used), F.lit(0.0)), 4),
        **{f"{s}_average_retries_used": mean(retries(s)) for s in steps},
        "repair_used_count": total("repair_attempted"),
        "repair_success_count": total("repair_succeeded"),
    } if generation else dict.fromkeys((
        "fallback_count", "fallback_rate", "verifier_fallback_count", "verifier_fallback_rate",
        "schema_success_rate", "answer_schema_success_rate", "verifier_schema_success_rate",
        "average_retries_used", "answer_average_retries_used", "verifier_average_retries_used",
        "repair_used_count", "repair_success_count"), F.max(nothing.cast("double")))
    aggregates += [value.alias(name) for name, value in figures.items()]
    return results.groupBy(*by).agg(*aggregates)
