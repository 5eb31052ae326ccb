"""Splitting a text inside its own row: sections and passages as arrays of spans.

Nothing here explodes or shuffles. A document's spans, their offsets and their
running index come out of one row, so splitting a corpus needs no exchange
and no window over the (possibly huge) set of passages of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from groundsieve.functions.text import SPACE, SPACE_CHARS, strip

# Unicode noncharacters (never valid in interchanged text) used as split marks.
_CUT, _SPLIT = "\ufdd0", "\ufdd1"

# How a heading line looks.
HEADING_PATTERN = r"^(#{1,4}\s+.+|[A-Z][A-Z\s\d:,.-]{3,}|^\d+[\.\)]\s+.{3,})$"

PARAGRAPHS_PER_SECTION = 10
SENTENCES_PER_PASSAGE = 3
_BLOCK = 256
_CHUNK = 16384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` (lambdas see no common subexpressions)."""
    return F.transform(F.array(value), body)[0]


def value_counts(items: Column) -> Column:
    """Distinct items of an array in order with their counts, as (value, n): the
    runs of the sorted array, found inside the row."""
    def runs(ordered: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(heads, lambda h: F.transform(h, lambda first, n: F.struct(
            F.get(ordered, first).alias("value"),
            (F.coalesce(F.get(h, n + 1), F.size(ordered)) - first).alias("n"),
        )))

    # Without items there is no run; the sequence would count down from 0.
    return let(F.sort_array(items), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered))
               .otherwise(F.slice(F.transform(ordered, lambda v: F.struct(
                   v.alias("value"), F.lit(0).alias("n"))), 1, 0)))


def _prefix_sums(numbers: Column) -> Column:
    return F.aggregate(
        numbers, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)
    )


def running_offsets(lengths: Column) -> Column:
    """For every element the sum of those before it.

    Appending copies the array, so one fold would be quadratic in the number
    of lines; folding blocks of 256 and then the block totals is not.
    """
    def fold(sizes: Column) -> Column:
        last_block = F.greatest(F.ceil(F.size(sizes) / _BLOCK).cast("int") - 1, F.lit(0))
        blocks = F.transform(
            F.sequence(F.lit(0), last_block),
            lambda b: _prefix_sums(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        return let(blocks, lambda sums: let(
            _prefix_sums(F.transform(sums, lambda s: F.element_at(s, -1))),
            lambda base: F.flatten(F.transform(
                sums, lambda s, b: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + base[b])
            )),
        ))

    return let(lengths, fold)


def _piece_spans(pieces: Column, gap: int, start: Column, trimmed: bool) -> Column:
    """Spans of pieces that lie one after the other with ``gap`` characters between them.

    ``trimmed`` moves both offsets to the stripped text, else they keep the
    blanks around it.
    """
    def span(piece: Column, offset: Column) -> Column:
        text = strip(piece)
        lead = F.length(piece) - F.length(F.ltrim(piece, F.lit(SPACE_CHARS)))
        first = start + offset + (lead if trimmed else 0)
        size = F.length(text) if trimmed else F.length(piece)
        return F.struct(text.alias("text"), first.alias("start_offset"),
                        (first + size).alias("end_offset"))

    offsets = running_offsets(F.transform(pieces, lambda p: F.length(p) + gap))
    spans = let(pieces, lambda p: let(offsets, lambda o: F.zip_with(p, o, span)))
    return F.filter(spans, lambda s: s["text"] != "")


def line_passages(text: Column, start: Column, compat: bool = False) -> Column:
    """One passage per line that is not blank."""
    return _piece_spans(F.split(text, "\n"), 1, start, trimmed=not compat)


def paragraph_passages(text: Column, start: Column, compat: bool = False) -> Column:
    """One passage per block between empty lines.

    ``compat`` keeps the raw block offsets, which begin at the second newline
    before every block but the first.
    """
    return _piece_spans(F.split(text, r"\n(?=\n)"), 1, start, trimmed=not compat)


def sentence_passages(
    text: Column, start: Column, compat: bool = False, group_size: int = SENTENCES_PER_PASSAGE
) -> Column:
    """Groups of ``group_size`` sentences, joined by one blank.

    Offsets run from the first to the last sentence of the group. ``compat``
    looks the joined group up in the text instead and, where it is not found
    verbatim, takes the end of the group before.
    """
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(SPACE_CHARS)))
    marked = F.regexp_replace(strip(text), rf"(?U)(?<=[.!?])({SPACE}+)", "$1" + _CUT)

    def group(pieces: Column, offsets: Column, begin: Column) -> Column:
        last = F.ceil(F.size(pieces) / group_size).cast("int") - 1

        def span(g: Column) -> Column:
            members = F.slice(pieces, g * group_size + 1, F.lit(group_size))
            first = begin + offsets[g * group_size]
            length = F.aggregate(members, F.lit(0), lambda acc, m: acc + F.length(m))
            tail = F.element_at(members, -1)
            blanks = F.length(tail) - F.length(strip(tail))
            joined = F.array_join(F.transform(members, strip), " ")
            return F.struct(joined.alias("text"), first.alias("start_offset"),
                            (first + length - blanks).alias("end_offset"))

        return F.transform(F.sequence(F.lit(0), last), span)

    spans = let(F.split(marked, _CUT), lambda pieces: let(
        running_offsets(F.transform(pieces, F.length)), lambda offsets: let(
            start + lead, lambda begin: group(pieces, offsets, begin))))
    if compat:
        spans = let(spans, lambda s: _looked_up(s, text, start))
    return F.filter(spans, lambda s: s["text"] != "")


def _looked_up(spans: Column, text: Column, start: Column) -> Column:
    empty = F.slice(spans, 1, 0)

    def step(acc: Column, span: Column) -> Column:
        begin = F.when(F.size(acc) == 0, 0).otherwise(F.element_at(acc, -1)["end_offset"] - start)
        found = F.position(span["text"], text, begin + 1)
        first = start + F.when(found > 0, found - 1).otherwise(begin)
        return F.array_append(acc, F.struct(
            span["text"].alias("text"), first.alias("start_offset"),
            (first + F.length(span["text"])).alias("end_offset")))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(spans, empty, step))


def passage_spans(
    strategy: Column, text: Column, start: Column, compat: bool = False,
    group_size: int = SENTENCES_PER_PASSAGE,
) -> Column:
    """Passages of a section text by strategy name; an unknown name is an error."""
    return (
        F.when(strategy == "natural_units", line_passages(text, start, compat))
        .when(strategy == "paragraph", paragraph_passages(text, start, compat))
        .when(strategy == "sentence_group", sentence_passages(text, start, compat, group_size))
        .otherwise(F.raise_error(F.concat(F.lit("unknown passage strategy: "), strategy)))
    )


def _section(kind: str, title, order, start, end, text, metadata=None) -> Column:
    return F.struct(
        F.lit(kind).alias("section_type") if isinstance(kind, str) else kind.alias("section_type"),
        title.cast("string").alias("title"),
        order.cast("int").alias("order_index"),
        start.cast("int").alias("start_offset"),
        end.cast("int").alias("end_offset"),
        (F.create_map().cast("map<string,string>") if metadata is None else metadata)
        .alias("metadata"),
        text.alias("text"),
    )


def _whole(text: Column) -> Column:
    return F.array(_section("document", F.lit(None), F.lit(0), F.lit(0), F.length(text), text))


def heading_sections(text: Column) -> Column:
    """A section from every heading to the next; text before the first heading belongs to none.

    The pattern may span lines, so it runs over the whole text at once and
    leaves a mark before and after each heading to split on.
    """
    marked = F.regexp_replace(text, "(?mdU)" + HEADING_PATTERN, f"{_CUT}$1{_SPLIT}")

    def build(pieces: Column, sizes: Column) -> Column:
        offsets = running_offsets(sizes)
        spans = let(offsets, lambda o: F.transform(pieces, lambda piece, i: _section(
            "heading", strip(F.split(piece, _SPLIT)[0]), i - 1, o[i], o[i] + sizes[i],
            F.replace(piece, F.lit(_SPLIT), F.lit("")))))
        return F.slice(spans, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    # Every piece but the first carries one mark inside, which is no text.
    return let(F.split(marked, _CUT), lambda pieces: F.when(F.size(pieces) == 1, _whole(text)).otherwise(
        let(F.transform(pieces, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1)),
            lambda sizes: build(pieces, sizes))))


def paragraph_sections(text: Column, per_section: int = PARAGRAPHS_PER_SECTION) -> Column:
    """Sections of up to ``per_section`` paragraphs of a normalised text."""
    groups = let(F.split(text, r"\n{2,}"), lambda parts: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(parts) / per_section).cast("int") - 1),
        lambda g: F.array_join(F.slice(parts, g * per_section + 1, F.lit(per_section)), "\n\n"),
    ))
    return let(groups, lambda chunks: let(
        running_offsets(F.transform(chunks, lambda c: F.length(c) + 2)),
        lambda offsets: F.transform(chunks, lambda chunk, g: _section(
            "paragraph_group", F.lit(None), g, offsets[g], offsets[g] + F.length(chunk), chunk)),
    ))


def explicit_sections(text: Column, boundaries: Column) -> Column:
    """Sections at given offsets: ends are cut to the text, sections that start past it go.

    ``boundaries`` is an array of structs with title, section_type,
    start_offset, end_offset and metadata; a section keeps its place in it.
    """
    def section(b: Column, i: Column, chunks: Column, size: Column) -> Column:
        start = b["start_offset"].cast("int")
        end = F.least(b["end_offset"].cast("int"), size)
        first = F.floor(start / _CHUNK).cast("int")
        near = F.slice(chunks, first + 1, F.floor(end / _CHUNK).cast("int") - first + 1)
        body = F.substring(F.array_join(near, ""), start - first * _CHUNK + 1, end - start)
        return _section(
            F.coalesce(b["section_type"], F.lit("chapter")), b["title"], i, start, end,
            F.when(end > start, body).otherwise(""),
            F.coalesce(b["metadata"], F.create_map().cast("map<string,string>")),
        )

    # A substring counts characters from the start of its text; taking it from
    # the few chunks around it keeps many sections of a long text linear.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return let(pieces, lambda chunks: let(F.length(text), lambda size: F.filter(
        F.transform(boundaries, lambda b, i: section(b, i, chunks, size)),
        lambda s: s["start_offset"] < size)))


def section_spans(
    strategy: Column, text: Column, boundaries: Column | None = None,
    per_section: int = PARAGRAPHS_PER_SECTION,
) -> Column:
    """Sections by strategy name; anything but ``explicit`` and ``heading`` groups paragraphs."""
    fallback = paragraph_sections(text, per_section)
    out = F.when(strategy == "heading", heading_sections(text))
    if boundaries is not None:
        out = out.when((strategy == "explicit") & boundaries.isNotNull(),
                       explicit_sections(text, boundaries))
    return out.otherwise(fallback)
