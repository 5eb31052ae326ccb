"""Documents to sections, passages and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.spans import passage_spans, section_spans
from groundsieve.functions.text import normalize_text, token_count

BOUNDARIES = (
    "array<struct<title:string,section_type:string,start_offset:int,end_offset:int,"
    "metadata:map<string,string>>>"
)


def split_documents(documents: DataFrame, compat: bool = False,
                    normalized: bool = False) -> DataFrame:
    """One row per document with its sections and, numbered by position, its passages.

    Needs document_id, text, sectioning_strategy and passage_strategy; an
    optional section_boundaries column serves the ``explicit`` strategy.
    """
    boundaries = (
        F.col("section_boundaries") if "section_boundaries" in documents.columns
        else F.lit(None).cast(BOUNDARIES)
    )
    text = F.col("text") if normalized else normalize_text(F.col("text"))
    sectioned = documents.withColumn("text", text).withColumn(
        "sections", section_spans(F.col("sectioning_strategy"), F.col("text"), boundaries)
    )
    strategy = F.col("passage_strategy")
    spans = F.flatten(F.transform("sections", lambda s: F.transform(
        passage_spans(strategy, s["text"], s["start_offset"], compat),
        lambda p: F.struct(
            s["order_index"].alias("section_order"), s["title"].alias("section_title"),
            p["text"].alias("text"), p["start_offset"].alias("start_offset"),
            p["end_offset"].alias("end_offset"),
        ),
    )))
    return sectioned.withColumn("passages", spans)


def exploded(rows: DataFrame, array: str, item: str, index: str | None = None) -> DataFrame:
    """document_id with one row per array element.

    The plain explode would make the optimizer add a filter on the size of the
    array and compute the whole split a second time for it; the outer one does not.
    """
    source = rows.select("document_id", array)
    if index:
        out = source.select("document_id", F.posexplode_outer(array).alias(index, item))
    else:
        out = source.select("document_id", F.explode_outer(array).alias(item))
    return out.where(F.col(item).isNotNull())


def section_id(document_id: Column, order: Column) -> Column:
    return F.concat(document_id.cast("string"), F.lit("-s"), order.cast("string"))


def passage_id(document_id: Column, index: Column) -> Column:
    return F.concat(document_id.cast("string"), F.lit("-"), index.cast("string"))


def sections_table(split: DataFrame) -> DataFrame:
    s = F.col("section")
    return exploded(split, "sections", "section").select(
        "document_id",
        section_id(F.col("document_id"), s["order_index"]).alias("section_id"),
        s["section_type"].alias("section_type"), s["title"].alias("title"),
        s["order_index"].alias("order_index"), s["start_offset"].alias("start_offset"),
        s["end_offset"].alias("end_offset"), s["metadata"].alias("metadata"),
    )


def passages_table(split: DataFrame) -> DataFrame:
    """Passages of split documents. A piece of a normalised text is normalised
    itself, so normalized_text needs no second pass."""
    p = F.col("passage")
    return exploded(split, "passages", "passage", "passage_index").select(
        "document_id",
        section_id(F.col("document_id"), p["section_order"]).alias("section_id"),
        passage_id(F.col("document_id"), F.col("passage_index")).alias("passage_id"),
        "passage_index",
        p["text"].alias("text"), p["text"].alias("normalized_text"),
        p["start_offset"].alias("start_offset"), p["end_offset"].alias("end_offset"),
        token_count(p["text"]).alias("token_count"),
        p["section_title"].alias("section_title"), p["section_order"].alias("section_order"),
    )


def windows_table(split: DataFrame, radius: int = 1) -> DataFrame:
    """Context windows of split documents, cut from the passage array of each row: no shuffle."""
    last = F.size("passages") - 1

    def window(_: Column, i: Column) -> Column:
        low, high = F.greatest(i - radius, F.lit(0)), F.least(i + radius, last)
        members = F.slice("passages", low + 1, high - low + 1)
        return F.struct(
            i.alias("anchor"), low.alias("low"), high.alias("high"),
            F.array_join(F.transform(members, lambda m: m["text"]), " ").alias("text"),
        )

    w = F.col("window")
    doc = F.col("document_id")
    windows = split.select("document_id", F.transform("passages", window).alias("windows"))
    return exploded(windows, "windows", "window").select(
        "document_id",
        passage_id(doc, w["anchor"]).alias("anchor_passage_id"),
        w["anchor"].alias("anchor_passage_index"),
        w["low"].alias("start_passage_index"), w["high"].alias("end_passage_index"),
        F.transform(F.sequence(w["low"], w["high"]), lambda i: passage_id(doc, i))
        .alias("included_passage_ids"),
        w["text"].alias("text"), w["text"].alias("normalized_text"),
    )


def context_windows(passages: DataFrame, radius: int = 1, block: int = 1024) -> DataFrame:
    """Context windows of any passage table; index gaps inside a window are skipped.

    The index range of a document is cut into blocks and every passage is also
    sent to the neighbouring block it can reach, so a window never has to see a
    whole document: one document with most of the rows spreads over many tasks.
    """
    block = max(block, radius)
    index = F.col("passage_index")
    home = F.floor(index / block)
    reach = F.sequence(F.floor((index - radius) / block), F.floor((index + radius) / block))

    ends = passages.groupBy("document_id", home.alias("block")).agg(
        F.min(index).alias("low"), F.max(index).alias("high"))
    whole = W.partitionBy("document_id")
    ends = ends.select(
        "document_id", "block",
        F.min("low").over(whole).alias("first_index"), F.max("high").over(whole).alias("last_index"),
    )

    near = W.partitionBy("document_id", "block").orderBy("passage_index").rangeBetween(
        -radius, radius)
    member = F.struct("passage_id", "text", "normalized_text")
    spread = passages.select(
        "document_id", "passage_id", "passage_index", "text", "normalized_text",
        home.alias("home"), F.explode(reach).alias("block"),
    ).withColumn("members", F.collect_list(member).over(near))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("members", lambda m: m[field]), " ")

    return (
        spread.where(F.col("home") == F.col("block"))
        .join(ends, ["document_id", "block"])
        .select(
            "document_id",
            F.col("passage_id").alias("anchor_passage_id"),
            index.alias("anchor_passage_index"),
            F.greatest(index - radius, F.col("first_index")).alias("start_passage_index"),
            F.least(index + radius, F.col("last_index")).alias("end_passage_index"),
            F.transform("members", lambda m: m["passage_id"]).alias("included_passage_ids"),
            joined("text").alias("text"), joined("normalized_text").alias("normalized_text"),
        )
    )
