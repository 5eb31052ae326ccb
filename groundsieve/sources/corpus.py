"""Reading corpora: plain texts, document tables, and unit-per-line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.functions.spans import let, running_offsets
from groundsieve.functions.text import infer_passage_strategy, normalize_text


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents, named by their place below ``path``: files of one name in
    two folders are two documents. Spark raises if the path does not exist."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(place_below(path).alias("document_id"), F.col("value").alias("text"))


def place_below(path: str) -> Column:
    """The file's path below a folder; the bare name for the file itself, the whole path for a pattern."""
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if any(c in path for c in "*?[{"):
        return full
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    below = F.substring_index(full, root + "/", -1)
    return F.when(F.endswith(full, F.lit(root)), F.element_at(F.split(full, "/"), -1)).otherwise(below)


def as_documents(
    rows: DataFrame, document_id: str = "doc_id", text: str = "text",
    sectioning: str = "paragraph", passages: str | None = None,
) -> DataFrame:
    """Documents ready to ingest; without a passage strategy each text chooses its own."""
    strategy = F.lit(passages) if passages else infer_passage_strategy(F.col(text))
    return rows.select(
        F.col(document_id).cast("string").alias("document_id"), F.col(text).alias("text"),
        F.lit(sectioning).alias("sectioning_strategy"), strategy.alias("passage_strategy"))


def only_project(documents: DataFrame, project_id: str) -> DataFrame:
    """Documents of one project: a filter on the partition column of stored tables."""
    return documents.where(F.col("project_id") == project_id)


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), F.asc("document_id"))


def _unit_lines(text: Column) -> Column:
    """(chapter, unit, text, start_offset, end_offset) of the well-formed lines of a text."""
    def parsed(lines: Column) -> Column:
        def unit(line: Column, offset: Column) -> Column:
            parts = F.split(line, r"\|", 3)
            return F.struct(
                F.trim(F.get(parts, 0)).try_cast("int").alias("chapter"),
                F.get(parts, 1).alias("unit"), F.get(parts, 2).alias("text"),
                offset.alias("start_offset"), (offset + F.length(line) + 1).alias("end_offset"))

        return let(running_offsets(F.transform(lines, lambda l: F.length(l) + 1)),
                   lambda offsets: F.zip_with(lines, offsets, unit))

    units = let(F.split(text, "\n"), parsed)
    return F.filter(units, lambda u: u["chapter"].isNotNull() & u["text"].isNotNull())


def parse_units(documents: DataFrame) -> DataFrame:
    """``chapter|unit|text`` lines as rows; other lines are skipped."""
    units = documents.select("document_id", _unit_lines(F.col("text")).alias("units"))
    return units.select("document_id", F.inline_outer("units")).where("chapter is not null")


def with_chapter_boundaries(
    documents: DataFrame, titles: dict[int, str] | None = None, compat: bool = False
) -> DataFrame:
    """Adds section_boundaries, one per chapter of a unit-per-line text, from the
    start of its first line to behind its last; null if there is no unit line.

    Sections are cut from the normalised text, so the offsets are taken there;
    ``compat`` takes them from the raw text. ``titles`` names chapters. The
    boundaries of a text come out of its own row, so no text is shuffled.
    """
    text = F.col("text") if compat else normalize_text(F.col("text"))
    marks = F.transform(_unit_lines(text), lambda u: F.struct(
        u["chapter"].alias("chapter"), u["start_offset"].alias("start"), u["end_offset"].alias("end")))

    def chapters(ordered: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["chapter"] != F.get(ordered, i - 1)["chapter"]))
        return let(firsts, lambda f: F.transform(f, lambda first, n: _boundary(
            F.get(ordered, first),
            F.get(ordered, F.coalesce(F.get(f, n + 1), F.size(ordered)) - 1)["end"], titles)))

    # Lines do not overlap, so the last one of a chapter by start ends it.
    found = let(F.array_sort(marks), lambda ordered: F.when(F.size(ordered) > 0, chapters(ordered)))
    return documents.withColumn("section_boundaries", found)


def _boundary(first: Column, end: Column, titles: dict[int, str] | None) -> Column:
    number = first["chapter"].cast("string")
    name = F.concat(F.lit("Chapter "), number)
    if titles:
        pairs = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
        name = F.coalesce(F.try_element_at(pairs, first["chapter"]), name)
    return F.struct(
        name.alias("title"), F.lit("chapter").alias("section_type"),
        first["start"].alias("start_offset"), end.alias("end_offset"),
        F.create_map(F.lit("chapter_number"), number).alias("metadata"))
