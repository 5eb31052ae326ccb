"""Anchors, their context and the evidence bundle of every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.sources.places import PassagePlaces, neighbourhood
from groundsieve.sources.staging import sent, stage

SCORES = ("lexical", "dense", "hybrid", "rerank")


def take_anchors(candidates: DataFrame, top_k: int, min_score: float | None = None) -> DataFrame:
    """The first ``top_k`` reranked candidates, if wanted only those that reach ``min_score``."""
    anchors = candidates.where(F.col("rank_rerank") < top_k)
    return anchors if min_score is None else anchors.where(F.col("rerank_score") >= min_score)


def expand_context(
    anchors: DataFrame, passages: DataFrame, radius: int = 1, by: tuple = ("query_id",)
) -> DataFrame:
    """Anchors with the passages of their document up to ``radius`` places away.

    Each anchor asks for its 2 * radius + 1 places, which makes the band join
    an equi-join on (document, place); no task sees more than one place's
    askers. An anchor that is in no passage table keeps its own text, if the
    candidate carries one, as its whole context.
    """
    base = _own_columns(anchors, by)
    keys = anchors.select("passage_id").distinct()

    # The passages are only ever filtered by what the anchors ask for, so with
    # few anchors they are scanned in place and never shuffled. The anchors'
    # own rows are needed twice and written down to spare a scan.
    here = stage(passages.join(sent(keys), "passage_id", "left_semi").select(
        "passage_id", "document_id", "passage_index", "text", "section_title", "section_order"),
        "anchor_rows")
    found = base.join(here, "passage_id", "left")

    places = F.sequence(F.greatest(F.col("passage_index") - radius, F.lit(0)),
                        F.col("passage_index") + radius)
    asked = found.where(F.col("passage_index").isNotNull()).select(
        *by, F.col("passage_id").alias("anchor_id"), "document_id",
        F.explode(places).alias("passage_index"))
    near = passages.select("document_id", "passage_index", "passage_id", "text").join(
        sent(asked), ["document_id", "passage_index"])
    windows = _gathered(near, by)
    return _contexts(found, windows, by)


def _gathered(near: DataFrame, by: tuple) -> DataFrame:
    """The members of each anchor's window, by their places."""
    member = F.struct("passage_index", "passage_id", "text")
    return near.groupBy(*by, F.col("anchor_id").alias("passage_id")).agg(
        F.array_sort(F.collect_list(member)).alias("members"))


def _contexts(found: DataFrame, windows: DataFrame, by: tuple) -> DataFrame:
    return found.join(windows, [*by, "passage_id"], "left").select(
        *by, "passage_id",
        F.coalesce("text", "own_passage_text", F.lit("")).alias("anchor_text"),
        F.when(F.col("passage_index").isNull(), F.col("own_section_title"))
        .otherwise(F.col("section_title")).alias("section_title"),
        F.col("section_order").alias("section_order_index"),
        F.coalesce(F.col("members.passage_id"), F.array("passage_id")).alias("window_passage_ids"),
        F.coalesce(F.array_join("members.text", " "), "own_passage_text", F.lit(""))
        .alias("window_text"),
        F.col("members.text").alias("window_texts"),
    )


def _own_columns(anchors: DataFrame, by: tuple) -> DataFrame:
    """Anchors with the text and the title that the candidates carry, null where they carry none."""
    carried = {"passage_text": "string", "section_title": "string"}
    return anchors.select(*by, "passage_id", *[
        (F.col(c) if c in anchors.columns else F.lit(None)).cast(kind).alias(f"own_{c}") for c, kind in carried.items()])


def context_from_places(
    anchors: DataFrame, store: PassagePlaces, radius: int = 1, by: tuple = ("query_id",)
) -> DataFrame:
    """The contexts of ``expand_context`` from passages that are stored by neighbourhood.

    Only anchors move: to the bucket that knows the place of their passage, then to
    those that hold its neighbours. Neither passage table is shuffled or broadcast,
    however many anchors there are. Each distinct passage is looked up once.
    """
    base = _own_columns(anchors, by)
    keys = anchors.select("passage_id").distinct()
    here = stage(store.places.hint("merge").join(keys, "passage_id"), "anchor_places")
    index, size = F.col("passage_index"), store.size
    low, high = F.greatest(index - radius, F.lit(0)), index + radius
    asked = here.select(
        F.col("passage_id").alias("anchor_id"), low.alias("low"), high.alias("high"), F.explode(F.transform(
            F.sequence(F.floor(low / size), F.floor(high / size)), lambda b: neighbourhood(F.col("document_id"), b)))
        .alias("neighbourhood"))
    near = store.passages.hint("merge").join(asked, "neighbourhood").where(
        (F.col("passage_index") >= F.col("low")) & (F.col("passage_index") <= F.col("high")))
    windows = _gathered(near, ())
    found = base.join(here, "passage_id", "left")
    known = found.join(windows, "passage_id", "left").select(*by, "passage_id", "members")
    return _contexts(found, known, by)


def context_from_windows(
    anchors: DataFrame, windows: DataFrame, by: tuple = ("query_id",)
) -> DataFrame:
    """The same contexts read from a window table that was built with the passages; with few
    anchors the windows are scanned where they lie and never shuffled."""
    windows = windows.select(F.col("anchor_passage_id").alias("passage_id"),
                             F.col("included_passage_ids").alias("window_passage_ids"),
                             F.col("text").alias("window_text"))
    return windows.join(sent(anchors.select(*by, "passage_id")), "passage_id").select(
        *by, "passage_id", "window_passage_ids", "window_text")


def _score_map() -> Column:
    entries = F.map_from_entries(F.array(*[
        F.struct(F.lit(name), F.round(f"{name}_score", 4)) for name in SCORES]))
    return F.map_filter(entries, lambda _, score: score.isNotNull())


def _share_budget(anchors: Column, limit: int) -> Column:
    """For every anchor of a query, in rank order, the window ids it may keep.

    Each passage belongs to the first anchor whose window holds it and the
    ids stop at ``limit``; anchors that come after that get null and drop out.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("seen"), F.array().cast("array<array<string>>").alias("kept"))

    def step(state: Column, anchor: Column) -> Column:
        room = F.lit(limit) - F.size(state["seen"])
        fresh = F.slice(F.array_except(anchor["window_passage_ids"], state["seen"]), 1,
                        F.greatest(room, F.lit(0)))
        kept = F.when(room > 0, fresh)
        return F.struct(
            F.concat(state["seen"], fresh).alias("seen"),
            F.concat(state["kept"], F.array(kept)).alias("kept"),
        )

    return F.aggregate(anchors, start, step, lambda state: state["kept"])


def evidence_bundles(
    anchors: DataFrame, contexts: DataFrame, top_k_anchors: int = 6, max_passages: int = 12,
    by: tuple = ("query_id",),
) -> DataFrame:
    """One bundle per query: its anchors by rank (from 1) with scores and deduplicated windows.

    The anchors of a query are few (``top_k_anchors``), so they are folded as
    an array in the row of the query. ``window_text`` stays the whole window;
    ``kept_text`` holds the kept passages only.
    """
    place = F.col("rank_rerank")
    joined = anchors.where(place < top_k_anchors).select(
        *by, "passage_id", (place + 1).alias("rank"), _score_map().alias("scores"),
    ).join(contexts, [*by, "passage_id"])
    item = F.struct("rank", "passage_id", F.col("anchor_text").alias("text"), "scores",
                    "section_title", "section_order_index", "window_passage_ids", "window_text",
                    "window_texts")
    # Maps cannot be compared, so the sort looks at the rank alone.
    grouped = joined.groupBy(*by).agg(F.collect_list(item).alias("found")).withColumn(
        "found", F.array_sort("found", lambda a, b: a["rank"] - b["rank"]))

    def finished(anchor: Column, ids: Column) -> Column:
        texts = F.coalesce(anchor["window_texts"], F.array(anchor["window_text"]))
        parts = F.filter(F.arrays_zip(anchor["window_passage_ids"].alias("id"), texts.alias("text")),
                         lambda p: F.array_contains(ids, p["id"]))
        return F.when(ids.isNotNull(), F.struct(
            anchor["passage_id"].alias("passage_id"), anchor["text"].alias("text"),
            anchor["rank"].alias("rank"), anchor["scores"].alias("scores"),
            anchor["section_title"].alias("section_title"),
            anchor["section_order_index"].alias("section_order_index"),
            ids.alias("window_passage_ids"), anchor["window_text"].alias("window_text"),
            F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("kept_text"),
        ))

    return grouped.withColumn("kept", _share_budget(F.col("found"), max_passages)).select(
        *by, F.lit("source_only").alias("mode"),
        F.array_compact(F.zip_with("found", "kept", finished)).alias("anchors"))


def bundle_anchors(bundles: DataFrame, by: tuple = ("query_id",)) -> DataFrame:
    """Bundles as one row per anchor."""
    return bundles.select(*by, F.inline("anchors"))
