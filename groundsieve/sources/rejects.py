"""Permissive reading: every row that comes in goes on as it should or becomes a reject.

Each reader here returns one table in which ``reason`` is null for the rows that passed;
``accepted`` and ``rejected`` part it. A reject keeps where it came from (source and place,
from 0), why it is one, and what it was, so that rows in = rows out + rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.functions.outputs import fits
from groundsieve.functions.spans import let, running_offsets
from groundsieve.sources.corpus import place_below

_REJECT = ("source", "place", "reason", "raw")
# Kind of an item's field: "text", a list of texts, or what a variant calls it. Required ones first.
_ITEM = {"id": "text", "question": "text"}
_COMMON = {"mode": "text", "category": "text", "notes": "text"}
_EVAL = _COMMON | {"expected_relevant_passage_ids": ["text"], "acceptable_alternative_passage_ids": ["text"],
                   "minimum_expected_count": "BIGINT", "ambiguity_flag": "BOOLEAN"}
_QUESTION = _COMMON | {"expected_verse_refs": ["text"]}


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("source", "place", "reason", "raw")


def rejected(checked: DataFrame) -> DataFrame:
    """source, place, reason and raw."""
    return checked.where(F.col("reason").isNotNull()).select(*_REJECT)


def check_texts(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as documents(document_id, text). Files that are no UTF-8 are rejects,
    with their bytes in base64. A file may have 2 GB at most; Spark's readers pass over files
    without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.col("content")
    text = content.cast("string")
    reason = F.when(~F.is_valid_utf8(text), "not UTF-8")
    name = place_below(path)
    return files.select(
        name.alias("document_id"), F.when(reason.isNull(), text).alias("text"), name.alias("source"),
        F.lit(None).cast("int").alias("place"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.base64(content)).alias("raw"))


def check_units(documents: DataFrame) -> DataFrame:
    """The lines of documents(document_id, text) as units (chapter, unit, text and offsets, as
    ``parse_units`` gives them). Lines that are blank, have fewer than three fields or
    whose chapter is no whole number are rejects, and so is a document without a text."""
    def parsed(lines: Column) -> Column:
        def line(raw: Column, offset: Column) -> Column:
            parts = F.split(raw, r"\|", 3)
            chapter = F.trim(F.get(parts, 0)).try_cast("int")
            reason = F.when(F.trim(raw) == "", "blank").when(F.size(parts) < 3, "fewer than three fields").when(
                chapter.isNull(), "chapter is no number")
            return F.struct(
                chapter.alias("chapter"), F.get(parts, 1).alias("unit"), F.get(parts, 2).alias("text"),
                offset.alias("start_offset"), (offset + F.length(raw) + 1).alias("end_offset"),
                reason.alias("reason"), raw.alias("raw"))

        return let(running_offsets(F.transform(lines, lambda x: F.length(x) + 1)),
                   lambda offsets: F.zip_with(lines, offsets, line))

    rows = documents.select(
        "document_id", F.posexplode_outer(let(F.split("text", "\n"), parsed)).alias("place", "line"))
    line = F.col("line")
    return rows.select(
        "document_id", *[line[c].alias(c) for c in ("chapter", "unit", "text", "start_offset", "end_offset")],
        F.col("document_id").cast("string").alias("source"), "place",
        F.when(line.isNull(), "no text").otherwise(line["reason"]).alias("reason"), line["raw"].alias("raw"))


def _check_items(spark: SparkSession, path: str, fields: dict) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        place_below(path).alias("source"), "value", F.try_parse_json("value").alias("parsed"))
    rows = files.select("source", "value", "parsed", F.posexplode_outer(
        F.try_variant_get("parsed", "$", "array<variant>")).alias("place", "item"))
    item = F.col("item")

    def field(name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "variant")

    def right(value: Column, kind) -> Column:
        if kind in ("BIGINT", "BOOLEAN"):
            return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))
        return fits(value, kind)

    def given(value: Column) -> Column:
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))

    whole = F.coalesce(F.schema_of_variant("parsed"), F.lit(""))
    reason = F.when(F.col("parsed").isNull(), "no JSON").when(~whole.startswith("ARRAY"), "no list of items").when(
        item.isNull(), F.lit("an empty list")).when(~F.schema_of_variant(item).startswith("OBJECT"), "no object")
    for name, kind in _ITEM.items():
        reason = reason.when(~given(field(name)), f"{name} is missing").when(
            ~right(field(name), kind), f"{name} has the wrong type")
    for name, kind in fields.items():
        reason = reason.when(given(field(name)) & ~right(field(name), kind), f"{name} has the wrong type")
    types = {"text": "string", "BIGINT": "int", "BOOLEAN": "boolean"}
    columns = [F.try_variant_get(item, f"$.{n}", "array<string>" if isinstance(k, list) else types[k]).alias(n)
               for n, k in (_ITEM | fields).items()]
    return rows.select(*columns, "source", "place", reason.alias("reason"),
                       F.coalesce(F.to_json("item"), "value").alias("raw"))


def _named(checked: DataFrame, defaults: dict, renamed: dict) -> DataFrame:
    out = checked.withColumns({n: F.coalesce(n, v) for n, v in defaults.items()})
    return out.withColumnsRenamed({"id": "query_id"} | renamed)


def check_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Eval items as ``read_eval_items`` gives them. Files that are no JSON list, entries that are no
    object, and items whose id or question is missing or whose fields have the wrong type are rejects."""
    none = F.array().cast("array<string>")
    return _named(_check_items(spark, path, _EVAL), {
        "mode": F.lit("source_only"), "category": F.lit("direct_lookup"), "notes": F.lit(""),
        "expected_relevant_passage_ids": none, "acceptable_alternative_passage_ids": none,
        "minimum_expected_count": F.lit(1), "ambiguity_flag": F.lit(False),
    }, {"expected_relevant_passage_ids": "expected_ids", "acceptable_alternative_passage_ids": "alternative_ids"})


def check_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions as ``read_questions`` gives them; rejects as in ``check_eval_items``."""
    return _named(_check_items(spark, path, _QUESTION), {
        "mode": F.lit("source_only"), "category": F.lit("general"), "notes": F.lit(""),
        "expected_verse_refs": F.array().cast("array<string>")}, {"expected_verse_refs": "refs"})
