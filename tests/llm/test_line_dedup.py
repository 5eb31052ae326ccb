"""The edit join against all pairs of lines in plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from groundsieve.llm import line_dedup
from groundsieve.llm.line_dedup import LineOptions
from llm_tools import documents, prose

BLANK = " \t\n\x0b\f\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def altered(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.34:
            out.insert(at, rng.choice("xyzé"))
        elif kind < 0.67:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rng.choice("xyzé")
    return "".join(out)


def expected(rows, options):
    """Text of each (id, text) after removal, by comparing all pairs."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    lines = [(d, n, l.strip(BLANK)) for d in docs for n, l in enumerate(d[2].split("\n")) if l.strip(BLANK)]
    texts = sorted({l for _, _, l in lines})
    group = {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[k + 1:]:
            if min(len(a), len(b)) >= options.least and abs(len(a) - len(b)) <= options.edits \
                    and distance(a, b) <= options.edits:
                group[root(a)] = root(b)
    return docs, lines, root


def check(spark, rows, options=LineOptions()):
    frame = documents(spark, rows)
    docs, lines, root = expected(rows, options)
    out = line_dedup.deduplicated(frame, options)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text is None, r.text or "") for r in out.collect())
    assert len(got) == len(rows)
    # Ids are unique in the rows that come here, so the order of lines is clear.
    first = {}
    for d, n, l in lines:
        first.setdefault(root(l), (d, n))
    want = []
    for i, t in rows:
        if t is None:
            want.append(((i is None, i or 0), True, ""))
            continue
        d = (i is None, i or 0, t)
        kept = [l for n, l in enumerate(t.split("\n"))
                if not l.strip(BLANK) or first[root(l.strip(BLANK))] == (d, n)]
        want.append(((i is None, i or 0), False, "\n".join(kept)))
    assert got == sorted(want)


def test_against_all_pairs(spark):
    rng = random.Random(11)
    base = prose(rng, 8, 6).split("\n")
    rows = []
    for i in range(60):
        lines = [altered(rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4]), rng) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join([*lines, *prose(rng, 1, 5).split("\n"), rng.choice(["", "  ", "short one", "tiny"])])))
    check(spark, [*rows, (90, None), (91, ""), (92, " \n\t")])
    check(spark, rows[:20], LineOptions(edits=1, least=8))


def test_one_line_with_many_variants(spark):
    """Variants four edits apart share most segments but are not near."""
    rng = random.Random(2)
    line = prose(rng, 1, 20)
    rows = [(i, f"{line[: 3 * i % 90]}qqqq{line[3 * i % 90:]}\nown line number {i} of this document") for i in range(40)]
    check(spark, rows)


def test_messy(messy, messy_rows):
    rows = line_dedup.line_report(messy).collect()
    assert len(rows) == len(messy_rows)
    by_text = [r for r in rows if r.doc_id == 7]
    assert by_text[0].text == "" and by_text[0].n_dropped == by_text[0].n_lines == 6  # all in document 1
    same = [r.text for r in rows if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1] != ""
    assert sorted(r.n_lines for r in rows if r.doc_id in (3, 4, 5)) == [0, 0, 0]
    assert [r.text for r in rows if r.doc_id == 3] == [None]


def test_report_has_the_kept_text(messy):
    rows = line_dedup.line_report(messy).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    kept = [(r.doc_id, r.text) for r in line_dedup.deduplicated(messy).collect()]
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(kept, key=key)
    assert all(r.n_dropped == len(r.dropped) for r in rows)


def test_nothing(nothing):
    assert line_dedup.line_report(nothing).count() == 0


def test_banded_distance(spark):
    rng, rows = random.Random(4), []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 14)))
        b = altered(a, rng.randint(0, 4), rng)
        short, long = sorted((a, b), key=len)
        if len(long) - len(short) <= 2:
            rows.append((short, long, distance(short, long)))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    frame = spark.createDataFrame(rows, "a string, b string, d int")
    for r in frame.select("d", line_dedup.banded_distance(chars("a"), chars("b"), 2).alias("got")).collect():
        assert r.got == r.d if r.d <= 2 else r.got > 2


def test_blocks_of_a_busy_key_lose_no_pair(spark, monkeypatch):
    """Every near pair of a key comes out, and the same pairs in blocks as in one piece."""
    rng = random.Random(8)
    base = prose(rng, 1, 12)
    texts = sorted({altered(base, k % 4, rng) for k in range(40)} | {"é" * 20, "é" * 21})
    lines = line_dedup.with_parities(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    held = lines.select(F.lit(1).cast("long").alias("key"), "id", F.lit(1).alias("own"))
    near = {frozenset((a, b)) for b in range(len(texts)) for a in range(b) if distance(texts[a], texts[b]) <= 2}
    found = []
    for block in (3, 2048):
        monkeypatch.setattr(line_dedup, "_BLOCK", block)
        rows = line_dedup.close_pairs(held, lines, 2).collect()
        assert all(len(texts[r.a]) <= len(texts[r.b]) for r in rows)
        found.append({frozenset((r.a, r.b)) for r in rows})
        assert len(found[-1]) == len(rows)
    assert near <= found[0] == found[1]


def test_later_passes_read_keys_instead_of_texts(spark):
    lines = ["\t a line that is long enough \x0b", "short", " a line that is long enough ", " \r"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    options = LineOptions()
    kept = line_dedup.numbered_lines(docs).orderBy("line").collect()
    assert [r["text"] for r in kept] == [lines[0].strip(BLANK), "short", lines[2]]
    keyed = line_dedup.keyed_lines(docs, options)
    assert "text" not in keyed.columns
    rows = keyed.orderBy("line").collect()
    lookups = line_dedup.segment_lookups(options.edits)
    assert [r["keys"] and len(r["keys"]) for r in rows] == [len(lookups), None, len(lookups)]
    each = line_dedup.one_by_one(keyed.where("keys is not null").select(F.col("h1").alias("id"), "keys"), options.edits)
    assert [r["n"] for r in each.groupBy("id").agg(F.sum("own").alias("n")).collect()] == [options.edits + 1] * 2
