"""Line deduplication by a segment-partition edit join, in built-in functions only.

Lines are compared without outer white space. Equal lines meet by a 128-bit
hash. Lines of at least ``least`` characters are near if at most ``edits``
insertions, deletions or replacements of a character lie between them: a line cut into
``edits`` + 1 segments leaves one segment whole in each near line, so a line
looks up, for each length that the other may have, the substrings of its own
that could be such a segment (places that no other choice of segment would
find are enough). Keys are hashes of length, segment number and substring.

1. Partial sums before the shuffle find the keys with several lines: one number
   for each key moves, however many lines share it.
2. The lines of those keys alone are looked up again, and each of them gets the
   parities of its letter pairs, 256 bits. An edit flips four of them at most, so the
   join by key compares lengths and parities, numbers only, and few pairs leave it
   that are not near. A key with thousands of lines is joined in blocks of them.
3. Each such pair is taken once, with its texts, to a banded bit-parallel edit distance.
4. Components of the near pairs are classes. Of each class the first line stays,
   in the order of document id and line; later ones leave their documents.

Defined results: blank lines are no lines and stay; a null text stays null; rows
of one id and one text are treated alike, rows of one id with other texts each by
themselves; a missing id comes last; documents stay even if all of their lines go;
an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from groundsieve.llm.graph import components
from groundsieve.llm.quality import SPACE
from groundsieve.sources.staging import stage

_FILTER_WORDS = 1 << 18
_ID_BITS = 28  # of a line's hash that tell whether a key has several lines
_SIGN_WORDS = 4    # of 64 parities
_FLIPS = 4         # parities that one edit can change: two letter pairs go, two come
_BLOCK = 2048      # lines of one key that are joined as one
_PAIRS = 256       # pairs of a task that takes edit distances


@dataclass(frozen=True)
class LineOptions:
    edits: int = 2
    least: int = 20   # characters; shorter lines are compared for equality alone


def segment_lookups(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment number from 0, shift) of the
    substrings to look up; those of (0, segment, 0) are a line's own segments."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            left, right = i, edits - i  # edits that may lie before and behind the segment
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                out.append((shorter, i, shift))
    return out


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """The lines with ``keys``: those of the lookups of their ``text``, in the order of ``segment_lookups``."""
    parts = edits + 1
    # For each length of the other line: the length, its segments' size, and how
    # many of them (the last ones) are longer by one.
    lengths = []
    for shorter in range(parts):
        other = F.length("text") - shorter
        lengths += [other.alias(f"length{shorter}"), ((other - other % parts) / parts).cast("int").alias(f"base{shorter}"),
                    (other % parts).alias(f"longer{shorter}")]
    keys = []
    for shorter, i, shift in segment_lookups(edits):
        length, base, longer = (F.col(f"{c}{shorter}") for c in ("length", "base", "longer"))
        before = F.greatest(longer - (parts - i), F.lit(0))  # longer segments before this one
        text = F.substring("text", base * i + before + (shift + 1), base + (longer >= parts - i).cast("int"))
        keys.append(F.xxhash64(length, F.lit(i), text))
    return lines.select("*", *lengths).select(*lines.columns, F.array(*keys).alias("keys"))


def one_by_one(lines: DataFrame, edits: int) -> DataFrame:
    """id, key, and whether it is a line's own segment (own), of each of the keys of lines(id, keys)."""
    own = [at for at, (shorter, _, shift) in enumerate(segment_lookups(edits)) if shorter == shift == 0]
    return lines.select("id", F.posexplode("keys").alias("at", "key")).select(
        "id", "key", F.col("at").isin(own).cast("int").alias("own"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def banded_distance(short: Column, long: Column, edits: int) -> Column:
    """The edit distance of two character arrays where it is at most ``edits``,
    something larger otherwise; ``long`` has up to ``edits`` characters more.

    A band of 2 * edits + 1 diagonals fits one number: each step takes a
    character of the long line and moves the whole band by bit operations."""
    width = 2 * edits + 1
    full, bottom = (1 << width) - 1, 1 << (width - 1)
    first = sum(1 << r for r in range(width) if r > edits)

    def big(value: int) -> Column:
        return F.lit(value).cast("long")

    def step(held: Column, j: Column) -> Column:
        equal = big(0)
        for r in range(width):
            same = F.get(short, j - edits + r - 1) == F.get(long, j - 1)
            equal = equal + F.when(same, big(1 << r)).otherwise(big(0))

        def diagonal(x):
            zero = ((x["m"].bitwiseAND(x["p"]) + x["p"]).bitwiseXOR(x["p"])).bitwiseOR(x["m"]).bitwiseOR(x["n"])
            return F.struct(zero.bitwiseAND(big(full)).alias("d"), x["p"].alias("p"), x["n"].alias("n"))

        def horizontal(x):
            plus = x["n"].bitwiseOR(F.bitwise_not(x["d"].bitwiseOR(x["p"])))
            return F.struct(
                x["d"].alias("d"),
                F.shiftleft(plus, 1).bitwiseOR(big(1)).bitwiseAND(big(full)).alias("h"),
                F.shiftleft(x["d"].bitwiseAND(x["p"]), 1).bitwiseAND(big(full)).alias("g"))

        def result(x):
            return F.struct(
                x["g"].bitwiseOR(F.bitwise_not(x["d"].bitwiseOR(x["h"]))).bitwiseAND(big(full)).alias("p"),
                x["d"].bitwiseAND(x["h"]).alias("n"),
                (held["score"] + F.when(x["d"].bitwiseAND(big(bottom)) == 0, 1).otherwise(0)).alias("score"))

        moved = F.struct(equal.alias("m"), F.shiftright(held["p"], 1).bitwiseOR(big(bottom)).alias("p"),
                         F.shiftright(held["n"], 1).alias("n"))
        return _let(_let(_let(moved, diagonal), horizontal), result)

    def distance(held: Column) -> Column:
        above = F.size(short) - F.size(long) + edits + 1  # the band's rows from here on lie below the short line
        return held["score"] - F.bit_count(F.call_function("shiftright", held["p"], above)) + F.bit_count(
            F.call_function("shiftright", held["n"], above))

    start = F.struct(big(first).alias("p"), big(0).alias("n"), F.lit(edits).alias("score"))
    return F.aggregate(F.sequence(F.lit(1), F.size(long)), start, step, distance)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Where each line stands (doc, an ordered struct), its number, its two hashes
    and its trimmed text; blank lines are left out."""
    doc = document_key(docs)
    lines = docs.where(docs["text"].isNotNull()).select(
        doc.alias("doc"), F.posexplode(F.split(docs["text"], "\n")).alias("line", "raw"))
    # Few lines begin or end with white space, and only these are looked at character by character.
    outer = (F.ascii("raw") <= 32) | (F.ascii(F.substring("raw", -1, 1)) <= 32)
    trimmed = F.when(outer, F.btrim("raw", F.lit(SPACE))).otherwise(F.col("raw"))
    return lines.select("doc", "line", trimmed.alias("text")).where("text <> ''").select(
        "doc", "line", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def keyed_lines(docs: DataFrame, options: LineOptions) -> DataFrame:
    """The numbered lines with ``keys`` in place of their text; null keys where they are too short for near lines."""
    rows = segment_keys(numbered_lines(docs), options.edits)
    return rows.select("doc", "line", "h1", "h2", F.when(F.length("text") >= options.least, F.col("keys")).alias("keys"))


def document_key(docs: DataFrame) -> Column:
    key = docs["doc_id"].cast("long")
    return F.struct(key.isNull().alias("none"), key.alias("id"), F.xxhash64(docs["text"]).alias("words"))


def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be one of the keys, without a shuffle of the
    rows: a bitmap of the keys' hashes goes to all tasks. It has ``_FILTER_WORDS``
    rows at most however many keys there are; a full one only lets more rows through."""
    word = lambda key: F.pmod(key, F.lit(_FILTER_WORDS)).cast("int")
    bit = lambda key: F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(63)).cast("int")
    key = F.col("key")
    bitmap = stage(keys.groupBy(word(key).alias("word")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))).alias("bits")), "key-filter")
    found = rows.withColumn("word", word(key)).join(F.broadcast(bitmap), "word")
    return found.where(F.call_function("shiftright", F.col("bits"), bit(key)).bitwiseAND(F.lit(1)) == 1).drop(
        "word", "bits")


def characters(text: str) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def with_parities(lines: DataFrame) -> DataFrame:
    """``size`` in characters, and in ``parity0``... whether each of the hashed pairs of
    neighbouring letters (the last letter and the end being one too) is there an odd number of times."""
    pairs = F.zip_with("chars", F.slice("chars", 2, F.greatest(F.size("chars") - 1, F.lit(0))),
                       lambda c, then: F.xxhash64(c, then))
    words = [f"parity{w}" for w in range(_SIGN_WORDS)]

    def flip(held: Column, pair: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(pair, 8).bitwiseAND(F.lit(63)).cast("int"))
        return F.struct(*[F.when(F.pmod(pair, F.lit(_SIGN_WORDS)) == w, held[name].bitwiseXOR(bit)).otherwise(
            held[name]).alias(name) for w, name in enumerate(words)])

    start = F.struct(*[F.lit(0).cast("long").alias(name) for name in words])
    rows = lines.withColumn("chars", characters("text")).withColumn("parities", F.aggregate(pairs, start, flip))
    return rows.select("id", "text", F.length("text").alias("size"), "parities.*")


def close_pairs(held: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """a and b: lines of one key whose lengths and parities allow ``edits`` edits, each
    pair once; a is the shorter one, or that with the smaller hash. held(key, id, own)
    joins in blocks of at most about ``_BLOCK`` lines, so that no key is one task's work."""
    words = [f"parity{w}" for w in range(_SIGN_WORDS)]
    hot = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK).select(
        "key", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks"))
    marked = held.join(stage(hot, "hot-keys"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    lines = stage(marked.join(texts.select("id", "size", *words), "id"), "lines-of-keys")
    long = lines.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    short = lines.where("own = 1").select(
        "key", F.pmod("id", F.col("blocks")).cast("int").alias("block"),
        *[F.col(c).alias(f"short_{c}") for c in ("id", "size", *words)])
    flips = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"short_{c}"))) for c in words[1:]),
                F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"short_{words[0]}"))))
    close = (F.col("short_size").between(F.col("size") - edits, F.col("size"))
             & ((F.col("short_size") < F.col("size")) | (F.col("short_id") < F.col("id")))
             & (flips <= _FLIPS * edits))
    pairs = long.join(short, (long["key"] == short["key"]) & (long["block"] == short["block"]) & close)
    return pairs.select(F.col("short_id").alias("a"), F.col("id").alias("b")).distinct()


def near_pairs(docs: DataFrame, lines: DataFrame, options: LineOptions) -> DataFrame:
    """a and b: the hashes of lines that are near, each pair once, of the keyed lines of the documents."""
    edits = options.edits
    keyed = one_by_one(lines.where("keys is not null").select(F.col("h1").alias("id"), "keys"), edits)
    # One number for each key in the shuffle: the bits that any of its lines has, the
    # bits that any lacks, and whether one of them has the key as a segment of its own.
    # Lines differ if some bit is both had and lacked.
    mask = (1 << _ID_BITS) - 1
    bits = F.col("id").bitwiseAND(F.lit(mask))
    seen = F.shiftleft(bits, _ID_BITS).bitwiseOR(bits.bitwiseXOR(F.lit(mask))).bitwiseOR(
        F.shiftleft(F.col("own").cast("long"), 2 * _ID_BITS))
    had, lacked = F.shiftright("seen", _ID_BITS).bitwiseAND(F.lit(mask)), F.col("seen").bitwiseAND(F.lit(mask))
    busy = stage(keyed.groupBy("key").agg(F.bit_or(seen).alias("seen")).where(
        (had.bitwiseAND(lacked) != 0) & (F.shiftright("seen", 2 * _ID_BITS) == 1)).select("key"), "busy-keys")
    held = stage(maybe_among(keyed, busy).join(busy, "key").groupBy("key", "id").agg(
        F.max("own").alias("own")), "busy-lines")
    # The documents are asked for the texts of these lines alone.
    ids = stage(held.select(F.col("id").alias("key")).distinct(), "busy-ids")
    asked = maybe_among(numbered_lines(docs).where(F.length("text") >= options.least).select(
        F.col("h1").alias("key"), "text"), ids).join(ids, "key")
    texts = stage(with_parities(asked.groupBy(F.col("key").alias("id")).agg(F.first("text").alias("text"))), "busy-texts")
    candidates = stage(close_pairs(held, texts, edits), "close-pairs")
    # Few bytes and much work each, so the number of tasks goes by the pairs.
    pairs = candidates.join(texts.select(F.col("id").alias("a"), F.col("text").alias("short")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("long")), "b").repartition(
        -(-candidates.count() // _PAIRS) or 1)
    return differing_middles(pairs).where(
        banded_distance(F.col("short"), F.col("long"), edits) <= edits).select("a", "b")


def differing_middles(pairs: DataFrame) -> DataFrame:
    """a, b and as written arrays the characters of ``short`` and ``long`` without
    what both begin and both end with, which a shortest way of edits need not touch."""
    both = pairs.select("a", "b", characters("short").alias("short"), characters("long").alias("long"))

    def alike(short: Column, long: Column) -> Column:
        same = F.zip_with(short, F.slice(long, F.lit(1), F.size("short")), lambda x, y: x == y)
        return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size("short")).cast("int")

    counted = both.withColumn("front", alike(F.col("short"), F.col("long"))).withColumn(
        "back", alike(F.reverse("short"), F.reverse("long"))).withColumn(
        "back", F.least("back", F.size("short") - F.col("front")))
    return stage(counted.select("a", "b", *[
        F.slice(c, F.col("front") + 1, F.size(c) - F.col("front") - F.col("back")).alias(c)
        for c in ("short", "long")]), "middles")


def line_classes(docs: DataFrame, lines: DataFrame, options: LineOptions) -> DataFrame:
    """h1, h2, class, near and first (document and line) of each line whose class has several
    lines, of the keyed lines of the documents."""
    firsts = stage(lines.groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")), "first-lines")
    near = components(near_pairs(docs, lines, options)).select(F.col("node").alias("h1"), F.col("label").alias("class"))
    placed = stage(firsts.join(near, "h1", "left").where("n > 1 or class is not null"), "line-classes")
    alone = placed.where("class is null").select(
        "h1", "h2", F.col("h1").alias("class"), F.lit(False).alias("near"), "first")
    tied = placed.where("class is not null")
    lead = tied.groupBy("class").agg(F.min("first").alias("lead"))
    return alone.unionByName(tied.join(lead, "class").select(
        "h1", "h2", "class", F.lit(True).alias("near"), F.col("lead").alias("first")))


def repeated_lines(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """doc and its ``dropped`` lines: an array of (line, near), near being true for
    lines whose class has near lines besides equal ones."""
    # Lines are cut and hashed once; every later pass but that for the texts of some reads numbers.
    lines = stage(keyed_lines(docs, options), "keyed-lines")
    classes = stage(line_classes(docs, lines, options), "classes-of-lines")
    lines = lines.select("doc", "line", "h1", "h2")
    here = F.struct("doc", "line")
    return lines.join(classes, ["h1", "h2"]).where(here != F.col("first")).groupBy("doc").agg(
        F.collect_set(F.struct("line", "near")).alias("dropped"))


def with_kept_text(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """``row``: each document as it was; ``kept``: its text without repeated lines;
    ``dropped``: the lines that left, null if none did."""
    dropped = stage(repeated_lines(docs, options), "dropped-lines").select(
        F.col("doc.id").alias("id"), F.col("doc.words").alias("words"), "dropped")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), document_key(docs).alias("doc"))
    # Merged at every size, so that the plan and its shuffles grow evenly.
    joined = rows.join(dropped.hint("merge"), F.col("doc.id").eqNullSafe(F.col("id")) & (
        F.col("doc.words") == F.col("words")), "left")
    numbers = F.transform("dropped", lambda d: d["line"])
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda l, n: ~F.array_contains(numbers, n)), "\n")
    return joined.select("row", "dropped", F.when(
        F.col("dropped").isNull(), F.col("row.text")).otherwise(kept).alias("kept"))


def deduplicated(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """The documents without the lines that an earlier line repeats."""
    return with_kept_text(docs, options).select(
        *[F.col("kept" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """doc_id, n_lines (that are not blank), ``dropped`` (the numbers of the lines
    that an earlier line repeats), n_dropped, n_near (those with near lines in their
    class) and the kept text of every document."""
    lines = F.filter(F.split("row.text", "\n"), lambda l: F.btrim(l, F.lit(SPACE)) != "")
    numbers = F.array_sort(F.transform("dropped", lambda d: d["line"]))
    near = F.filter("dropped", lambda d: d["near"])
    none = F.col("dropped").isNull()
    return with_kept_text(docs.select("doc_id", "text"), options).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(none, F.array().cast("array<int>")).otherwise(numbers).alias("dropped"),
        F.when(none, 0).otherwise(F.size("dropped")).alias("n_dropped"),
        F.when(none, 0).otherwise(F.size(near)).alias("n_near"),
        F.col("kept").alias("text"))
