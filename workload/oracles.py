"""The same results in SQL, written out from the tables for a second engine."""

from __future__ import annotations

import re

from groundsieve.config import DEFAULT_EXPANSIONS, STOP_WORDS

NL = "chr(10)"
WS = "(' ' || chr(9) || chr(10) || chr(13))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
HEADING = r"(?m)^(#{1,4}\s+.+|[A-Z][A-Z\s\d:,.-]{3,}|^\d+[\.\)]\s+.{3,})$"


def norm(x: str) -> str:
    out = f"nfc_normalize({x})"
    for pattern, new in ((r"\r\n?", NL), (r"[ \t]+", "' '"), (r" *\n *", NL),
                         (r"\n{3,}", f"{NL} || {NL}")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return f"trim({out}, {WS})"


def norm_question(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({x}), '\\s+', ' ', 'g'), {WS})"


def messy(x: str) -> str:
    return (
        f"(' ' || chr(10) || chr(9) || replace(replace(replace({x}, ', ', ' ,' || chr(9) || '  '), "
        f"chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(10) || chr(10)), "
        f"'é', 'e' || chr(769)) || chr(10) || ' ' || chr(10))")


def spaced(x: str) -> str:
    return f"replace({x}, chr(10), chr(10) || chr(10))"


def headed(x: str) -> str:
    return f"regexp_replace({x}, '(^|\\n)([AET])', '\\1# \\2', 'g')"


def stem(w: str) -> str:
    n = f"length({w})"
    ends = lambda *xs: "(" + " OR ".join(f"ends_with({w}, '{x}')" for x in xs) + ")"
    cut = lambda k: f"left({w}, {n} - {k})"
    return (
        f"CASE WHEN {n} <= 3 THEN {w} "
        f"WHEN {ends('ies')} AND {n} > 4 THEN {cut(3)} || 'y' "
        f"WHEN {ends('ing')} AND {n} > 5 THEN {cut(3)} "
        f"WHEN {ends('ed')} AND {n} > 4 THEN {cut(2)} "
        f"WHEN {n} > 4 AND {ends('ches', 'shes', 'xes', 'zes', 'sses')} THEN {cut(2)} "
        f"WHEN {ends('s')} AND {n} > 4 AND NOT {ends('ss')} AND NOT {ends('ses')} THEN {cut(1)} "
        f"ELSE {w} END")


def tokens(x: str, compat: bool = False) -> str:
    words = f"string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    first = "w <> ''" if compat else f"w <> '' AND NOT list_contains({STOP}, w)"
    kept = f"list_filter({words}, lambda w: {first})"
    return (f"list_filter(list_transform({kept}, lambda w: {stem('w')}), "
            f"lambda w: w <> '' AND NOT list_contains({STOP}, w))")


def word_list(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"


def letter_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z]+'))"


def first_k(ids: str, relevant: str, k: int) -> str:
    return f"len(list_filter({ids}[1:{k}], lambda i: list_contains({relevant}, i)))"


def _lines(text: str) -> str:
    """Lines of (doc_id, t) with running offsets."""
    return (
        f"SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id "
        f"ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ("
        f"SELECT doc_id, unnest(string_split(t, {NL})) AS line, "
        f"generate_subscripts(string_split(t, {NL}), 1) - 1 AS pos FROM {text})")


def _parts(text: str) -> str:
    return (
        f"SELECT doc_id, pos, part, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id "
        f"ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ("
        f"SELECT doc_id, unnest(string_split(t, {NL} || {NL})) AS part, "
        f"generate_subscripts(string_split(t, {NL} || {NL}), 1) - 1 AS pos FROM {text})")


def _units(lines: str) -> str:
    whole = r"^\s*[+-]?\d+\s*$"
    return (
        f"SELECT doc_id, pos, s, TRY_CAST(split_part(line, '|', 1) AS INTEGER) AS chapter, "
        f"split_part(line, '|', 2) AS unit, "
        f"substr(line, length(split_part(line, '|', 1)) + length(split_part(line, '|', 2)) + 3) "
        f"AS text, s + length(line) + 1 AS e FROM {lines} "
        f"WHERE len(string_split(line, '|')) >= 3 "
        f"AND regexp_matches(split_part(line, '|', 1), '{whole}')")


SECTION = "doc_id::VARCHAR AS document_id, doc_id::VARCHAR || '-s' || o::VARCHAR AS section_id"
PASSAGE = f"{SECTION}, doc_id::VARCHAR || '-' || i::VARCHAR AS passage_id, i::INTEGER AS passage_index"
PASSAGE_REST = ("text, s::INTEGER AS start_offset, e::INTEGER AS end_offset, "
                f"len({word_list('text')})::INTEGER AS token_count")


def _bm25(suffix: str, compat: bool) -> dict[str, str]:
    """CTEs of the index and the scores of every question that shares a term."""
    query_terms = tokens("q.nq", compat)
    if compat:
        query_terms = tokens(f"array_to_string(list_distinct({query_terms}), ' ')", True)
    else:
        query_terms = f"list_distinct({query_terms})"
    return {
        f"ptok{suffix}": f"SELECT passage_id, {tokens('text', compat)} AS toks FROM pas",
        f"post{suffix}": f"SELECT passage_id, dl, term, count(*) AS tf FROM (SELECT passage_id, "
                         f"len(toks) AS dl, unnest(toks) AS term FROM ptok{suffix}) GROUP BY ALL",
        f"dfs{suffix}": f"SELECT term, count(*) AS df, sum(tf) AS cf, max(tf) AS mtf, "
                        f"sum(dl) AS sdl FROM post{suffix} GROUP BY term",
        f"sizes{suffix}": f"SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM ptok{suffix}",
        f"idfs{suffix}": f"SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM "
                         f"dfs{suffix}, sizes{suffix}",
        f"meanidf{suffix}": f"SELECT avg(raw) AS mean_idf FROM idfs{suffix}",
        f"qterms{suffix}": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, "
                           f"unnest({query_terms}) AS term FROM qs q) GROUP BY ALL",
        f"bm{suffix}": f"SELECT query_id, passage_id, round(sum(qtf * CASE WHEN raw < 0 THEN "
                       f"0.25 * mean_idf ELSE raw END * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl "
                       f"/ avgdl))), 6) AS score FROM qterms{suffix} JOIN idfs{suffix} USING (term) "
                       f"JOIN post{suffix} USING (term), sizes{suffix}, meanidf{suffix} "
                       f"GROUP BY query_id, passage_id",
    }


LISTS = {"lexical_ids": ("rl", "base"), "dense_ids": ("rd", "base"), "merged_ids": ("rh", "base"),
         "reranked_ids": ("rr", "rer")}


def _hybrid(alpha: str, beta: str, boost: str) -> str:
    return (f"round({alpha} * coalesce(ln, 0) + {beta} * coalesce(dn, 0) + {boost}, 6)")


_ORDER = "rl ASC NULLS LAST, rd ASC NULLS LAST, passage_id"

CTES: dict[str, str] = {
    # Passages by line, numbered per document.
    "base_text": f"SELECT doc_id, {norm('text')} AS t FROM documents",
    "parts": _parts("base_text"),
    "part_lines": f"SELECT doc_id, pos, lp, line, s0 + coalesce(sum(length(line) + 1) OVER ("
                  f"PARTITION BY doc_id, pos ORDER BY lp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
                  f"PRECEDING), 0) AS s FROM (SELECT doc_id, pos, s AS s0, "
                  f"unnest(string_split(part, {NL})) AS line, "
                  f"generate_subscripts(string_split(part, {NL}), 1) - 1 AS lp FROM parts)",
    "lines": "SELECT doc_id, pos // 10 AS o, row_number() OVER (PARTITION BY doc_id ORDER BY pos, lp)"
             " - 1 AS i, line AS text, s, s + length(line) AS e FROM part_lines WHERE line <> ''",
    "pas": "SELECT doc_id, i, doc_id::VARCHAR || '-' || i::VARCHAR AS passage_id, text, o FROM lines",
    "qs": f"SELECT item_id::VARCHAR AS query_id, text AS question, {norm_question('text')} AS nq "
          f"FROM benchmark",
    **_bm25("", False),
    **_bm25("_c", True),
    "lex": "SELECT query_id, passage_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY "
           "query_id ORDER BY score DESC, passage_id) - 1 AS r FROM bm WHERE score > 0) WHERE r < 30",
    # The hashing embedder.
    "ptoks": f"SELECT passage_id AS id, unnest({word_list('lower(text)')}) AS tok FROM pas",
    "qtoks": f"SELECT query_id AS id, unnest({word_list('lower(nq)')}) AS tok FROM qs",
    "pemb": "SELECT id, dim, sum(sign) AS w FROM (SELECT id, "
            "('0x' || substr(sha256(tok), 1, 8))::BIGINT % 384 AS dim, CASE WHEN "
            "substr(sha256(tok), 10, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END "
            "AS sign FROM ptoks) GROUP BY ALL",
    "qemb": "SELECT id, dim, sum(sign) AS w FROM (SELECT id, "
            "('0x' || substr(sha256(tok), 1, 8))::BIGINT % 384 AS dim, CASE WHEN "
            "substr(sha256(tok), 10, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END "
            "AS sign FROM qtoks) GROUP BY ALL",
    "pnorm": "SELECT id, sqrt(sum(w * w)::DOUBLE) AS n FROM pemb GROUP BY id HAVING sum(w * w) > 0",
    "qnorm": "SELECT id, sqrt(sum(w * w)::DOUBLE) AS n FROM qemb GROUP BY id HAVING sum(w * w) > 0",
    "dots": "SELECT q.id AS query_id, p.id AS passage_id, sum(q.w * p.w)::DOUBLE AS d FROM qemb q "
            "JOIN pemb p USING (dim) GROUP BY ALL",
    "cos": "SELECT qs.query_id, pas.passage_id, coalesce(round(d / (qn.n * pn.n), 6), 0.0) AS score "
           "FROM qs CROSS JOIN pas LEFT JOIN dots d ON d.query_id = qs.query_id AND d.passage_id = "
           "pas.passage_id LEFT JOIN qnorm qn ON qn.id = qs.query_id LEFT JOIN pnorm pn ON pn.id = "
           "pas.passage_id",
    "den": "SELECT query_id, passage_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY "
           "query_id ORDER BY score DESC, passage_id) - 1 AS r FROM cos) WHERE r < 30",
    # Fusion and reranking.
    "cand": "SELECT query_id, passage_id, l.score AS ls, l.r AS rl, d.score AS ds, d.r AS rd "
            "FROM lex l FULL OUTER JOIN den d USING (query_id, passage_id)",
    "scaled": "SELECT *, CASE WHEN ls IS NULL THEN NULL WHEN max(ls) OVER w > min(ls) OVER w THEN "
              "(ls - min(ls) OVER w) / (max(ls) OVER w - min(ls) OVER w) ELSE 0.0 END AS ln, "
              "CASE WHEN ds IS NULL THEN NULL WHEN max(ds) OVER w > min(ds) OVER w THEN "
              "(ds - min(ds) OVER w) / (max(ds) OVER w - min(ds) OVER w) ELSE 0.0 END AS dn, "
              "ls IS NOT NULL AND ds IS NOT NULL AS both_found FROM cand "
              "WINDOW w AS (PARTITION BY query_id)",
    "hyb": f"SELECT *, {_hybrid('0.5', '0.5', '0.0')} AS h FROM scaled",
    "base": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, {_ORDER}) - 1 "
            f"AS rh FROM hyb",
    "pairs": "SELECT c.query_id, c.passage_id, CASE WHEN p.i = 0 THEN 'nan'::DOUBLE ELSE "
             "len(list_intersect(q.terms, t.toks)) / greatest(len(q.terms), 1) END AS score "
             "FROM cand c JOIN pas p USING (passage_id) JOIN ptok t USING (passage_id) JOIN ("
             f"SELECT query_id, list_distinct({tokens('nq')}) AS terms FROM qs) q "
             "ON q.query_id = c.query_id WHERE p.i <> 1",
    "rscore": "SELECT b.*, CASE WHEN p.score IS NULL OR isnan(p.score) THEN h ELSE "
              "round(p.score, 6) END AS rs FROM base b LEFT JOIN pairs p USING (query_id, passage_id)"
              " WHERE rh < 25",
    "rer": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rh) - 1 AS rr "
           "FROM rscore",
    # Context and bundles.
    "anc": "SELECT * FROM rer WHERE rr < 6",
    "near": "SELECT a.query_id, a.passage_id, a.rr, n.i AS ni, n.passage_id AS nid, n.text AS ntext "
            "FROM anc a JOIN pas p USING (passage_id) JOIN pas n ON n.doc_id = p.doc_id AND n.i "
            "BETWEEN p.i - 1 AND p.i + 1",
    "mine": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr, ni) AS place FROM ("
            "SELECT *, row_number() OVER (PARTITION BY query_id, nid ORDER BY rr, ni) AS k FROM near) "
            "WHERE k = 1",
    "room": "SELECT a.query_id, a.passage_id, a.rr, count(m.nid) AS before FROM anc a LEFT JOIN mine "
            "m ON m.query_id = a.query_id AND m.rr < a.rr GROUP BY ALL",
    "kept": "SELECT query_id, rr, list(nid ORDER BY ni) AS ids, string_agg(ntext, ' ' ORDER BY ni) "
            "AS ktext FROM mine WHERE place <= 12 GROUP BY ALL",
    "bun": "SELECT r.query_id, r.passage_id, r.rr, coalesce(k.ids, []) AS ids, coalesce(k.ktext, '') "
           "AS ktext, p.text FROM room r JOIN pas p USING (passage_id) LEFT JOIN kept k ON "
           "k.query_id = r.query_id AND k.rr = r.rr WHERE r.before < 12",
    "got": "SELECT query_id, list(passage_id ORDER BY rr) AS anchors, flatten(list(ids ORDER BY rr)) "
           "AS windows FROM bun GROUP BY query_id",
    # Each id once, where it comes first.
    "retr": "SELECT query_id, any_value(anchors) AS anchors, list(id ORDER BY nth) AS ids FROM ("
            "SELECT query_id, anchors, id, min(nth) AS nth FROM (SELECT query_id, anchors, "
            "unnest(list_concat(anchors, windows)) AS id, "
            "generate_subscripts(list_concat(anchors, windows), 1) AS nth FROM got) GROUP BY ALL) "
            "GROUP BY query_id",
    # Gold.
    "qlines": f"SELECT item_id::VARCHAR AS query_id, unnest(string_split({norm('text')}, {NL})) AS l, "
              f"generate_subscripts(string_split({norm('text')}, {NL}), 1) AS nth FROM benchmark",
    "qquote": f"SELECT DISTINCT query_id, l AS quote FROM qlines WHERE len({word_list('l')}) >= 3",
    "goldp": "SELECT DISTINCT query_id, passage_id FROM qquote JOIN pas ON contains(pas.text, quote)",
    "gold": "SELECT query_id, coalesce(ids, []) AS g FROM qs LEFT JOIN (SELECT query_id, "
            "list(passage_id ORDER BY passage_id) AS ids FROM goldp GROUP BY query_id) "
            "USING (query_id)",
    "judged": "SELECT query_id, g, coalesce(ids, []) AS ids, coalesce(anchors, []) AS anchors "
              "FROM gold LEFT JOIN retr USING (query_id)",
    # Lists per stage and failures.
    "ids_l": "SELECT query_id, list(passage_id ORDER BY rl) AS l FROM base WHERE rl < 10 GROUP BY 1",
    "ids_d": "SELECT query_id, list(passage_id ORDER BY rd) AS d FROM base WHERE rd < 10 GROUP BY 1",
    "ids_m": "SELECT query_id, list(passage_id ORDER BY rh) AS m FROM base WHERE rh < 10 GROUP BY 1",
    "ids_r": "SELECT query_id, list(passage_id ORDER BY rr) AS r FROM rer WHERE rr < 10 GROUP BY 1",
    "hits": "SELECT query_id, g, coalesce(r, []) AS r, list_has_any(coalesce(l, []), g) AS hl, "
            "list_has_any(coalesce(d, []), g) AS hd, list_has_any(coalesce(m, []), g) AS hm, "
            "list_has_any(coalesce(r, []), g) AS hr, list_has_any(coalesce(r, [])[1:5], g) AS h5 "
            "FROM gold LEFT JOIN ids_l USING (query_id) LEFT JOIN ids_d USING (query_id) "
            "LEFT JOIN ids_m USING (query_id) LEFT JOIN ids_r USING (query_id)",
    "fails": "SELECT *, len(g) > 0 AND NOT hr AS failed, CASE WHEN len(g) = 0 OR hr THEN NULL "
             "WHEN NOT hl THEN 'lexical_miss' WHEN NOT hd THEN 'dense_miss' WHEN hm THEN "
             "'rerank_miss' ELSE 'unknown' END AS kind FROM hits",
    # Answers of a stand-in model and their checks.
    "top2": "SELECT query_id, max(CASE WHEN rr = 0 THEN passage_id END) AS p1, max(CASE WHEN rr = 0 "
            "THEN text END) AS t1, max(CASE WHEN rr = 1 THEN passage_id END) AS p2, "
            "max(CASE WHEN rr = 1 THEN text END) AS t2, query_id::INTEGER % 5 AS kind, "
            "list(passage_id ORDER BY rr)[1:3] AS top, list(text ORDER BY rr)[1:3] AS texts, "
            "count(*) AS n FROM bun GROUP BY query_id",
    "drafts": "SELECT *, kind = 4 OR n < 2 AS fallback FROM top2",
}


def _sql(final: str) -> str:
    """The final statement with the CTEs it needs, in order."""
    names, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in names and re.search(rf"\b{name}\b", text):
                names.add(name)
                todo.append(CTES[name])
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in names)
    return f"WITH {parts} {final}" if parts else final


def _metric_columns(null_without_gold: bool) -> str:
    out = []

    def add(name: str, value: str) -> None:
        judged = f"CASE WHEN len(g) > 0 THEN {value} END" if null_without_gold else value
        out.append(f"round(({judged})::DOUBLE, 6) AS {name}")

    def first(ids: str) -> str:
        return (f"coalesce(1.0 / list_min(list_filter(list_transform(g, lambda i: "
                f"list_position({ids}, i)), lambda p: p > 0)), 0.0)")

    for k in (5, 10, 20):
        found = first_k("ids", "g", k)
        add(f"hit_at_{k}", f"CASE WHEN {found} > 0 THEN 1.0 ELSE 0.0 END")
        add(f"recall_at_{k}", f"CASE WHEN len(g) = 0 THEN 1.0 ELSE {found} / len(g) END")
        add(f"precision_at_{k}", f"{found} / {k}")
    add("mrr", first("ids"))
    if null_without_gold:
        add("anchor_hit_at_5",
            f"CASE WHEN {first_k('anchors', 'g', 5)} > 0 THEN 1.0 ELSE 0.0 END")
        add("anchor_mrr", first("anchors"))
    return ", ".join(out)


def _infer(x: str) -> str:
    body = f"CASE WHEN right({x}, 1) = {NL} THEN left({x}, length({x}) - 1) ELSE {x} END"
    sizes = f"list_transform(string_split({body}, {NL}), lambda l: length(trim(l, {WS})))"
    return (
        f"(SELECT CASE WHEN u >= 3 AND n - u <= greatest(3, floor(n * 0.02)) AND (n - u) / n <= 0.2 "
        f"AND u / n >= 0.85 AND total / u < 220 THEN 'natural_units' ELSE 'paragraph' END FROM ("
        f"SELECT len({sizes}) AS n, len(list_filter({sizes}, lambda z: z > 0)) AS u, "
        f"list_sum({sizes}) AS total))")


def _unit_line(line: str = "line", pos: str = "pos") -> str:
    return (f"CASE WHEN {pos} % 5 = 4 THEN {line} ELSE ({pos} // 3 + 1)::VARCHAR || '|' || "
            f"({pos} + 1)::VARCHAR || '|' || {line} END")


def _unit_docs() -> str:
    """doc_id and the numbered text."""
    return (f"SELECT doc_id, string_agg({_unit_line()}, {NL} ORDER BY pos) AS t FROM ("
            f"SELECT doc_id, unnest(string_split(text, {NL})) AS line, "
            f"generate_subscripts(string_split(text, {NL}), 1) - 1 AS pos FROM documents) "
            f"GROUP BY doc_id")


CTES |= {
    "unit_docs": _unit_docs(),
    "unit_raw_lines": _lines("unit_docs"),
    "unit_rows": _units("unit_raw_lines"),
    "unit_norm": f"SELECT doc_id, {norm('t')} AS t FROM unit_docs",
    "unit_norm_lines": _lines("unit_norm"),
    "unit_norm_rows": _units("unit_norm_lines"),
    "chapters": "SELECT doc_id, chapter, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) - 1 "
                "AS o, min(s) AS s, least(max(e), any_value(length(t))) AS e FROM unit_norm_rows "
                "JOIN unit_norm USING (doc_id) GROUP BY doc_id, chapter",
    "spaced_text": f"SELECT doc_id, {norm(spaced('text'))} AS t FROM documents",
    "spaced_parts": _parts("spaced_text"),
    "head_marked": f"SELECT doc_id, t, regexp_replace(t, '{HEADING}', chr(64976) || '\\1' || "
                   f"chr(64977), 'g') AS m FROM (SELECT doc_id, {norm(headed('text'))} AS t "
                   f"FROM documents)",
    "head_pieces": "SELECT doc_id, piece, nth, length(piece) - CASE WHEN nth > 1 THEN 1 ELSE 0 END "
                   "AS size FROM (SELECT doc_id, unnest(string_split(m, chr(64976))) AS piece, "
                   "generate_subscripts(string_split(m, chr(64976)), 1) AS nth FROM head_marked)",
    "head_spans": "SELECT doc_id, piece, nth, size, coalesce(sum(size) OVER (PARTITION BY doc_id "
                  "ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, "
                  "count(*) OVER (PARTITION BY doc_id) AS n FROM head_pieces",
    "sec_text": f"SELECT doc_id, pos // 10 AS o, min(s) AS s0, string_agg(part, {NL} || {NL} "
                f"ORDER BY pos) AS t FROM parts GROUP BY doc_id, pos // 10",
    "sents": "SELECT doc_id, o, s0, nth, sent, coalesce(sum(length(sent)) OVER (PARTITION BY doc_id, "
             "o ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so FROM ("
             "SELECT doc_id, o, s0, unnest(string_split(regexp_replace(t, '([.!?])(\\s+)', '\\1\\2' "
             "|| chr(64976), 'g'), chr(64976))) AS sent, generate_subscripts(string_split("
             "regexp_replace(t, '([.!?])(\\s+)', '\\1\\2' || chr(64976), 'g'), chr(64976)), 1) - 1 "
             "AS nth FROM sec_text)",
    "sent_groups": f"SELECT doc_id, o, nth // 3 AS gno, string_agg(trim(sent, {WS}), ' ' ORDER BY nth) "
                   f"AS text, min(s0 + so) AS s, max(s0 + so + length(rtrim(sent, {WS}))) AS e "
                   f"FROM sents GROUP BY doc_id, o, nth // 3",
    "long_pas": f"SELECT doc_id, i, passage_id, text, min(i) OVER (PARTITION BY doc_id) AS lo, "
                f"max(i) OVER (PARTITION BY doc_id) AS hi FROM pas WHERE len({word_list('text')}) >= 10",
    # Model outputs made of conversation turns.
    "turns": "SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS query_id, a AS attempt, text, "
             "(conv_id + turn * 2 + a * 3) % 10 AS kind FROM conversations, "
             "(SELECT unnest([1, 2, 3]) AS a)",
    "checked": "SELECT query_id, attempt, text, kind, CASE WHEN kind = 7 THEN 'llm_error' WHEN kind = "
               "3 THEN 'json_parse' WHEN kind IN (4, 5, 6, 8) THEN 'schema_validation' END AS stage, "
               "kind IN (1, 2, 3, 9) AS tried, kind IN (1, 2, 9) AS mended FROM turns",
    "last_try": "SELECT query_id, coalesce(min(CASE WHEN stage IS NULL OR stage = 'llm_error' THEN "
                "attempt END), 3) AS n FROM checked GROUP BY query_id",
}

_SWEEP = {  # label: alpha, beta, boost, reranker, top_k
    "balanced": (0.5, 0.5, 0.0, True, 25), "boosted": (0.5, 0.5, 0.05, True, 25),
    "dense_heavy": (0.3, 0.7, 0.0, True, 25), "lexical_heavy": (0.7, 0.3, 0.0, True, 25),
    "no_reranker": (0.5, 0.5, 0.0, False, 25), "short_rerank": (0.5, 0.5, 0.0, True, 10),
}
CTES |= {
    "settings": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}, {n})"
        for k, (a, b, c, d, n) in _SWEEP.items())
        + ") AS v(label, alpha, beta, boost, reranker, top_k)",
    "sw_hyb": f"SELECT *, {_hybrid('alpha', 'beta', 'CASE WHEN both_found THEN boost ELSE 0.0 END')} "
              f"AS h FROM scaled, settings",
    "sw_base": f"SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY h DESC, {_ORDER})"
               f" - 1 AS rh FROM sw_hyb",
    "sw_rer": "SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY rs DESC, rh) - 1 "
              "AS rr FROM (SELECT b.*, CASE WHEN NOT reranker THEN 0.0 WHEN p.score IS NULL OR "
              "isnan(p.score) THEN h ELSE round(p.score, 6) END AS rs FROM sw_base b LEFT JOIN pairs p "
              "USING (query_id, passage_id) WHERE rh < top_k)",
    "sw_m": "SELECT label, query_id, list(passage_id ORDER BY rh) AS m FROM sw_base WHERE rh < 10 "
            "GROUP BY 1, 2",
    "sw_r": "SELECT label, query_id, list(passage_id ORDER BY rr) AS r FROM sw_rer WHERE rr < 10 "
            "GROUP BY 1, 2",
    "sw_hits": "SELECT label, query_id, g, list_has_any(coalesce(l, []), g) AS hl, "
               "list_has_any(coalesce(d, []), g) AS hd, list_has_any(m, g) AS hm, "
               "list_has_any(r, g) AS hr, list_has_any(r[1:5], g) AS h5 FROM gold JOIN sw_m "
               "USING (query_id) JOIN sw_r USING (label, query_id) LEFT JOIN ids_l USING (query_id) "
               "LEFT JOIN ids_d USING (query_id)",
}


def _expansion_values() -> str:
    rows = [(k, n, t) for k, terms in DEFAULT_EXPANSIONS.items() for n, t in enumerate(terms)]
    return ", ".join(f"('{k}', {n}, '{t}')" for k, n, t in rows)


_THEMES = "[" + ", ".join(f"'{k}'" for k in sorted(DEFAULT_EXPANSIONS)) + "]"
CTES |= {
    "themed": f"SELECT query_id, {tokens('x')} AS toks FROM (SELECT query_id, "
              f"'What does the text say about ' || {_THEMES}[query_id::INT % 10 + 1] || ' and ' || "
              f"{_THEMES}[(query_id::INT + 3) % 10 + 1] || '? ' || nq AS x FROM qs)",
    "expand": f"SELECT {stem('k')} AS key, n, {stem('w')} AS term FROM (VALUES "
              f"{_expansion_values()}) AS v(k, n, w)",
    "extras": "SELECT query_id, term, min(nth * 100 + n) AS place FROM (SELECT query_id, toks, "
              "unnest(toks) AS tok, generate_subscripts(toks, 1) AS nth FROM themed) JOIN expand ON "
              "key = tok WHERE NOT list_contains(toks, term) GROUP BY query_id, term",
    "extra_lists": "SELECT query_id, list(term ORDER BY place) AS extra FROM extras GROUP BY query_id",
    "themed_distinct": "SELECT query_id, list(tok ORDER BY nth) AS toks FROM (SELECT query_id, tok, "
                       "min(nth) AS nth FROM (SELECT query_id, unnest(toks) AS tok, "
                       "generate_subscripts(toks, 1) AS nth FROM themed) GROUP BY ALL) "
                       "GROUP BY query_id",
}

_OBJECTION = ("This answer was assembled directly from the top retrieved passages because the local "
              "model did not return the required schema.")
_NOTES = ("Fallback verification used deterministic passage/citation checks because the local model "
          "did not return the required schema.")
# Messages of the answer checks.
_NO_EVIDENCE = "Answer generator failed and no evidence was available for fallback"
_ALTERED = "Citation quote was not found verbatim in the anchor passage."
CTES |= {
    # supported and open claims, citations and issues of every draft
    "claims": "SELECT query_id, CASE WHEN fallback THEN list_transform(range(1, len(top) + 1), "
              "lambda n: 'fallback_c' || n::VARCHAR) WHEN kind IN (2, 3) THEN ['c2'] ELSE "
              "['c1', 'c2'] END AS good, CASE WHEN NOT fallback AND kind IN (2, 3) THEN ['c1'] ELSE "
              "[] END AS bad FROM drafts",
    "cites": "SELECT query_id, place, unnest_pid AS passage_id, quote FROM (SELECT query_id, "
             "unnest(range(0, len(top))) AS place, unnest(top) AS unnest_pid, "
             "unnest(list_transform(texts, lambda t: left(t, 240))) AS quote FROM drafts WHERE "
             "fallback UNION ALL SELECT query_id, 0, p1, CASE WHEN kind = 1 THEN left(t1, 20) || "
             "' ...' ELSE left(t1, 40) END FROM drafts WHERE NOT fallback UNION ALL SELECT query_id, "
             "1, p2, '' FROM drafts WHERE NOT fallback AND kind <> 2)",
    "cited": f"SELECT c.query_id, place, c.passage_id, quote, b.text AS passage_text, CASE WHEN quote "
             f"<> '' AND NOT contains(b.text, quote) THEN '{_ALTERED}' END AS issue FROM cites c "
             f"JOIN bun b ON b.query_id = c.query_id AND b.passage_id = c.passage_id",
    "verdict": "SELECT query_id, good, bad, CASE WHEN len(bad) > 0 THEN 'fail' ELSE "
               "'pass_with_warnings' END AS status FROM claims",
    # Reports of a stand-in verifier.
    "model_said": "SELECT d.query_id, n4 AS n, CASE WHEN fallback THEN 'skip' WHEN n4 = 3 THEN 'lost' ELSE 'structured' END AS "
                  "how, CASE WHEN n4 = 1 THEN 'fail' ELSE 'pass' END AS said, status, good, bad, ni, CASE WHEN fallback THEN "
                  "good ELSE ['c1', 'c2'] END AS every FROM (SELECT *, query_id::INTEGER % 4 AS n4 FROM drafts) d JOIN "
                  "verdict USING (query_id) JOIN (SELECT query_id, count(issue) AS ni FROM cited GROUP BY query_id) USING (query_id)",
    "grounded": "SELECT v.query_id, CASE WHEN d.fallback THEN 1.0 WHEN d.kind = 2 THEN 0.5 ELSE 1.0 "
                "END AS cvr, len(good) / (len(good) + len(bad)) AS csr, len(bad) AS open, status FROM "
                "verdict v JOIN drafts d USING (query_id)",
}


def _dense_vectors(usable: str) -> str:
    """The ten vectors that are usable and nearest to the mean vector of each label."""
    return (f"WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, "
            f"generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label, dim, "
            f"avg(x) AS x FROM d GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM d "
            f"WHERE {usable} GROUP BY ALL), cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY "
            f"ALL), s AS (SELECT c.label, d.vec_id, round(sum(c.x * d.x) / any_value(n.n * cn.n), 6) AS "
            f"score FROM c JOIN d USING (dim) JOIN n ON n.vec_id = d.vec_id JOIN cn ON cn.label = "
            f"c.label GROUP BY ALL) SELECT query_id, passage_id, score AS dense_score, "
            f"(r - 1)::INTEGER AS rank_dense FROM (SELECT label::VARCHAR AS query_id, vec_id::VARCHAR "
            f"AS passage_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, "
            f"vec_id::VARCHAR) AS r FROM s) WHERE r <= 10")


def oracles() -> dict[str, str]:
    r6 = lambda x: f"round({x}, 6)"
    section_cols = ("order_index::INTEGER AS order_index, s::INTEGER AS start_offset, "
                    "e::INTEGER AS end_offset")
    candidate = (
        "query_id, passage_id, ls AS lexical_score, ds AS dense_score, round(ln, 6) AS "
        "lexical_score_normalized, round(dn, 6) AS dense_score_normalized, both_found AS "
        "overlap_matched, {boost} AS overlap_boost, h AS hybrid_score, rh::INTEGER AS rank_hybrid")
    top = ("SELECT query_id, passage_id, score AS {score}, r::INTEGER AS {rank} FROM (SELECT *, "
           "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS r FROM "
           "{rows}) WHERE r < {k}")
    queries = {
        "normalize_text": f"SELECT doc_id, {norm(messy('text'))} AS normalized_text FROM documents",
        "normalize_question": f"SELECT conv_id, turn, {norm_question(messy('text'))} AS question "
                              f"FROM conversations",
        "tokenize_stem": f"SELECT doc_id, len({tokens('text')}) AS n_tokens, "
                         f"array_to_string({tokens('text')}, ' ') AS tokens, "
                         f"len({word_list('text')}) AS n_words FROM documents",
        "tokenize_stem_compat": f"SELECT doc_id, array_to_string({tokens('text', True)}, ' ') AS "
                                f"tokens FROM documents",
        "query_expansion": "SELECT query_id, array_to_string(coalesce(extra, []), ' ') AS "
                           "expanded_terms, array_to_string(list_concat(toks, coalesce(extra, [])), "
                           "' ') AS lexical_query FROM themed_distinct LEFT JOIN extra_lists "
                           "USING (query_id)",
        "infer_strategy": f"SELECT doc_id, {_infer('text')} AS strategy, {_infer(spaced('text'))} AS "
                          f"spaced_strategy FROM documents",
        "sections_paragraph": f"SELECT {SECTION}, 'paragraph_group' AS section_type, NULL::VARCHAR AS "
                              f"title, o::INTEGER AS order_index, s::INTEGER AS start_offset, "
                              f"e::INTEGER AS end_offset FROM (SELECT doc_id, pos // 10 AS o, "
                              f"min(s) AS s, max(s + length(part)) AS e FROM spaced_parts GROUP BY 1, 2)",
        "sections_heading": f"SELECT {SECTION}, section_type, title, o::INTEGER AS order_index, "
                            f"s::INTEGER AS start_offset, e::INTEGER AS end_offset FROM ("
                            f"SELECT doc_id, nth - 2 AS o, 'heading' AS section_type, "
                            f"trim(split_part(piece, chr(64977), 1), {WS}) AS title, s, s + size AS e "
                            f"FROM head_spans WHERE nth > 1 UNION ALL SELECT doc_id, 0, 'document', "
                            f"NULL, 0, size FROM head_spans WHERE n = 1)",
        "sections_explicit": f"SELECT {SECTION}, 'chapter' AS section_type, 'Chapter ' || "
                             f"chapter::VARCHAR AS title, o::INTEGER AS order_index, s::INTEGER AS "
                             f"start_offset, e::INTEGER AS end_offset FROM chapters",
        "unit_lines": "SELECT doc_id::VARCHAR AS document_id, chapter, unit, text, s::INTEGER AS "
                      "start_offset, e::INTEGER AS end_offset FROM unit_rows",
        "passages_lines": f"SELECT {PASSAGE}, {PASSAGE_REST} FROM lines",
        "passages_paragraphs": f"SELECT {PASSAGE}, {PASSAGE_REST} FROM (SELECT doc_id, pos // 10 AS "
                               f"o, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, "
                               f"part AS text, s, s + length(part) AS e FROM spaced_parts "
                               f"WHERE part <> '')",
        "passages_sentences": f"SELECT {PASSAGE}, {PASSAGE_REST} FROM (SELECT *, row_number() OVER ("
                              f"PARTITION BY doc_id ORDER BY o, gno) - 1 AS i FROM sent_groups "
                              f"WHERE text <> '')",
        "passages_explicit": f"SELECT {PASSAGE}, {PASSAGE_REST} FROM (SELECT l.doc_id, c.o, "
                             f"row_number() OVER (PARTITION BY l.doc_id ORDER BY c.o, l.s) - 1 AS i, "
                             f"l.line AS text, l.s, l.s + length(l.line) AS e FROM unit_norm_lines l "
                             f"JOIN chapters c ON c.doc_id = l.doc_id AND l.s >= c.s AND l.s < c.e "
                             f"WHERE l.line <> '')",
        "passage_windows": "SELECT a.doc_id::VARCHAR AS document_id, a.passage_id AS "
                           "anchor_passage_id, min(n.i)::INTEGER AS start_passage_index, "
                           "max(n.i)::INTEGER AS end_passage_index, string_agg(n.passage_id, ' ' "
                           "ORDER BY n.i) AS included_passage_ids, string_agg(n.text, ' ' ORDER BY "
                           "n.i) AS text FROM pas a JOIN pas n ON n.doc_id = a.doc_id AND n.i BETWEEN "
                           "a.i - 1 AND a.i + 1 GROUP BY a.doc_id, a.passage_id",
        "passage_windows_gaps": "SELECT a.doc_id::VARCHAR AS document_id, a.passage_id AS "
                                "anchor_passage_id, greatest(a.i - 2, a.lo)::INTEGER AS "
                                "start_passage_index, least(a.i + 2, a.hi)::INTEGER AS "
                                "end_passage_index, string_agg(n.passage_id, ' ' ORDER BY n.i) AS "
                                "included_passage_ids, string_agg(n.text, ' ' ORDER BY n.i) AS text "
                                "FROM long_pas a JOIN long_pas n ON n.doc_id = a.doc_id AND n.i "
                                "BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.doc_id, a.passage_id, a.i, "
                                "a.lo, a.hi",
        "bm25_stats": "SELECT n AS n_passages, round(avgdl, 6) AS mean_length, round(mean_idf, 6) AS "
                      "mean_idf FROM sizes, meanidf",
        "bm25_postings": "SELECT term, df, cf::BIGINT AS occurrences, mtf::INTEGER AS max_tf, "
                         "sdl::BIGINT AS total_length FROM dfs",
        "bm25_topk": top.format(score="lexical_score", rank="rank_lexical", k=10,
                                rows="bm WHERE score > 0"),
        "bm25_topk_blocks": top.format(score="lexical_score", rank="rank_lexical", k=10,
                                       rows="bm WHERE score > 0"),
        "bm25_topk_segments": top.format(score="lexical_score", rank="rank_lexical", k=10,
                                         rows="bm WHERE score > 0"),
        "bm25_topk_compat": top.format(
            score="lexical_score", rank="rank_lexical", k=30,
            rows="(SELECT qs.query_id, pas.passage_id, coalesce(b.score, 0.0) AS score FROM qs CROSS "
                 "JOIN pas LEFT JOIN bm_c b ON b.query_id = qs.query_id AND b.passage_id = "
                 "pas.passage_id)"),
        "hash_embed": "SELECT id AS passage_id, dim::INTEGER AS dim, round(w / n, 6) AS weight FROM "
                      "pemb JOIN pnorm USING (id) WHERE w <> 0",
        "dense_topk_hash": top.format(score="dense_score", rank="rank_dense", k=10, rows="cos"),
        "l2_normalize": "SELECT vec_id, dim::INTEGER AS dim, round(x / n, 6) AS value FROM ("
                        "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, "
                        "1) - 1 AS dim, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * "
                        "v::DOUBLE))) AS n FROM embeddings)",
        # Every seventh vector has a NaN, every eleventh is missing: neither is a hit.
        "dense_topk_broken": _dense_vectors("vec_id % 7 <> 3 AND vec_id % 11 <> 5"),
        "dense_topk_vectors": _dense_vectors("true"),
        "dense_topk_cells": _dense_vectors("true"),
        "hybrid_fusion": f"SELECT {candidate.format(boost='0.0::DOUBLE')}, CASE WHEN both_found THEN "
                         f"'lexical+dense' WHEN ls IS NULL THEN 'dense' ELSE 'lexical' END AS "
                         f"source_methods FROM base",
        "overlap_boost": "SELECT " + candidate.format(
            boost="CASE WHEN both_found THEN 0.05 ELSE 0.0 END::DOUBLE")
            + " FROM sw_base WHERE label = 'boosted'",
        "rerank_pairs": "SELECT query_id, passage_id, h AS hybrid_score, rs AS rerank_score, "
                        "rr::INTEGER AS rank_rerank FROM rer",
        "broken_pair_scores": "SELECT query_id, count(*) AS n_pairs, count_if(isnan(score))::BIGINT AS "
                              "n_broken FROM pairs GROUP BY query_id",
        "context_expand": "SELECT query_id, n.passage_id, any_value(p.text) AS anchor_text, "
                          "NULL::VARCHAR AS section_title, any_value(p.o)::INTEGER AS "
                          "section_order_index, string_agg(nid, ' ' ORDER BY ni) AS "
                          "window_passage_ids, string_agg(ntext, ' ' ORDER BY ni) AS window_text FROM "
                          "near n JOIN pas p ON p.passage_id = n.passage_id GROUP BY query_id, "
                          "n.passage_id",
        "evidence_bundle": "SELECT b.query_id, (b.rr + 1)::INTEGER AS rank, b.passage_id, b.text, "
                           "array_to_string(b.ids, ' ') AS window_passage_ids, b.ktext AS kept_text, "
                           "round(a.ls, 4) AS lexical_score, round(a.ds, 4) AS dense_score, "
                           "round(a.h, 4) AS hybrid_score, round(a.rs, 4) AS rerank_score FROM bun b "
                           "JOIN anc a ON a.query_id = b.query_id AND a.passage_id = b.passage_id",
        "retrieval_debug": f"SELECT qs.query_id, nq AS normalized_query, array_to_string(dt, ' ') AS "
                           f"lexical_query, array_to_string(l, ' ') AS lexical_hits, "
                           f"array_to_string(d, ' ') AS dense_hits, array_to_string(m, ' ') AS "
                           f"merged_candidates, array_to_string(m, ' ') AS reranked_candidates FROM qs "
                           f"JOIN (SELECT query_id, list(tok ORDER BY nth) AS dt FROM (SELECT query_id, "
                           f"tok, min(nth) AS nth FROM (SELECT query_id, unnest({tokens('nq')}) AS tok, "
                           f"generate_subscripts({tokens('nq')}, 1) AS nth FROM qs) GROUP BY ALL) GROUP "
                           f"BY query_id) USING (query_id) LEFT JOIN ids_l USING (query_id) LEFT JOIN "
                           f"ids_d USING (query_id) LEFT JOIN ids_m USING (query_id)",
        "gold_quotes": "SELECT query_id, passage_id FROM goldp",
        "gold_references": "WITH u AS (SELECT split_part(text, '|', 1) || '|' || split_part(text, "
                           "'|', 2) AS ref, min(doc_id::VARCHAR || '-' || i::VARCHAR) AS passage_id "
                           "FROM (SELECT doc_id, line AS text, row_number() OVER (PARTITION BY doc_id "
                           "ORDER BY s) - 1 AS i FROM unit_norm_lines WHERE line <> '') WHERE "
                           "regexp_matches(text, '^\\d+\\|\\d+(\\||$)') GROUP BY 1), w AS (SELECT "
                           "query_id, unnest(refs) AS ref, unnest([1, 2]) AS nth FROM (SELECT query_id, "
                           "['1|' || (query_id::INT % 3 + 1)::VARCHAR, (query_id::INT + 1)::VARCHAR || "
                           "'|' || (query_id::INT * 3 + 1)::VARCHAR] AS refs FROM qs)) SELECT "
                           "qs.query_id, coalesce(string_agg(passage_id, ' ' ORDER BY nth), '') AS "
                           "expected_ids FROM qs LEFT JOIN (w JOIN u USING (ref)) x ON x.query_id = "
                           "qs.query_id GROUP BY qs.query_id",
        "retrieval_metrics": f"SELECT query_id, array_to_string(ids, ' ') AS retrieved_ids, "
                             f"{_metric_columns(True)} FROM judged",
        "retrieval_metrics_compat": f"SELECT query_id, {_metric_columns(False)} FROM judged",
        "answer_drafts": "SELECT d.query_id, CASE WHEN fallback THEN 'fallback' ELSE 'structured' END "
                         "AS mode, CASE WHEN fallback THEN array_to_string(texts, ' ') ELSE t1 END AS "
                         "final_answer, CASE WHEN fallback THEN len(top) ELSE 2 END::INTEGER AS "
                         "n_claims, c.ids AS cited, CASE WHEN NOT fallback AND kind = 2 THEN 'ghost' "
                         "ELSE '' END AS unknown_ids, NOT fallback AND kind = 1 AS repair_succeeded "
                         "FROM drafts d JOIN (SELECT query_id, string_agg(passage_id, ' ' ORDER BY "
                         "place) AS ids FROM cites GROUP BY query_id) c USING (query_id)",
        "answer_prompts": "SELECT query_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || "
                          "'Mode:' || chr(10) || 'source_only' || chr(10) || chr(10) || 'Evidence "
                          "Passages:' || chr(10) || to_json({'query': question, 'mode': 'source_only', "
                          "'anchors': items})::VARCHAR || chr(10) || chr(10) || 'Instructions:' || "
                          "chr(10) || 'Answer using ONLY the provided passages.' || chr(10) || 'Cite "
                          "passages using passage_id.' || chr(10) || 'Return structured JSON according "
                          "to the schema.' || chr(10) || 'Return ONLY valid JSON, no other text.' AS "
                          "prompt FROM qs JOIN (SELECT b.query_id, list({'passage_id': b.passage_id, "
                          "'text': b.text, 'section_title': '', 'rank': b.rr + 1, 'window_text': "
                          "w.wtext} ORDER BY b.rr) AS items FROM bun b JOIN (SELECT query_id, rr, "
                          "string_agg(ntext, ' ' ORDER BY ni) AS wtext FROM near GROUP BY 1, 2) w ON "
                          "w.query_id = b.query_id AND w.rr = b.rr GROUP BY b.query_id) USING (query_id)",
        "verifier_prompts": "SELECT query_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || "
                            "'Evidence Passages:' || chr(10) || to_json({'query': question, 'mode': "
                            "'source_only', 'anchors': items})::VARCHAR || chr(10) || chr(10) || 'Answer "
                            "Draft to Verify:' || chr(10) || to_json({'final_answer': CASE WHEN fallback "
                            "THEN array_to_string(texts, ' ') ELSE t1 END, 'claims': CASE WHEN fallback "
                            "THEN list_transform(range(1, len(top) + 1), lambda n: {'claim_id': "
                            "'fallback_c' || n::VARCHAR, 'statement': texts[n], "
                            "'supporting_passage_ids': [top[n]], 'support_type': 'direct'}) ELSE "
                            "[{'claim_id': 'c1', 'statement': t1, 'supporting_passage_ids': CASE WHEN "
                            "kind IN (2, 3) THEN [] ELSE [p1] END, 'support_type': 'direct'}, "
                            "{'claim_id': 'c2', 'statement': t2, 'supporting_passage_ids': [p2], "
                            "'support_type': 'interpretive'}] END, 'supporting_citations': quoted})"
                            "::VARCHAR || chr(10) || chr(10) || 'Instructions:' || chr(10) || 'Verify "
                            "whether every claim in the answer draft is supported by the cited evidence "
                            "passages.' || chr(10) || 'Return structured JSON according to the schema.' "
                            "|| chr(10) || 'Return ONLY valid JSON, no other text.' AS prompt FROM qs "
                            "JOIN drafts USING (query_id) JOIN (SELECT query_id, list({'passage_id': "
                            "passage_id, 'text': text, 'section_title': ''} ORDER BY rr) AS items FROM "
                            "bun GROUP BY query_id) USING (query_id) JOIN (SELECT query_id, "
                            "list({'passage_id': passage_id, 'quote': quote} ORDER BY place) AS quoted "
                            "FROM cites GROUP BY query_id) USING (query_id)",
        "answer_rounds": "SELECT query_id, CASE WHEN NOT fallback AND kind IN (2, 3) THEN 2 ELSE 1 END"
                         "::INTEGER AS round, 'pass_with_warnings' AS verification_status, CASE WHEN "
                         "fallback THEN array_to_string(texts, ' ') ELSE t1 END AS final_answer FROM "
                         "drafts",
        "citation_check": "SELECT query_id, place::INTEGER AS place, passage_id, quote, passage_text, "
                          "issue FROM cited",
        "claim_support": "SELECT query_id, status, CASE WHEN fallback THEN 'deterministic_skip' ELSE "
                         "'deterministic_fallback' END AS mode, array_to_string(good, ' ') AS "
                         "supported, array_to_string(bad, ' ') AS unsupported FROM verdict JOIN drafts "
                         "USING (query_id)",
        "final_response": f"SELECT query_id, CASE WHEN status = 'fail' THEN '' WHEN fallback THEN "
                          f"array_to_string(texts, ' ') ELSE t1 END AS final_answer, CASE WHEN status = "
                          f"'fail' THEN 0 ELSE nc END::INTEGER AS n_citations, CASE WHEN status = "
                          f"'fail' THEN '' WHEN fallback THEN '{_OBJECTION}' ELSE 'open' END AS "
                          f"objections, status AS verification_status, CASE WHEN status = 'fail' THEN "
                          f"'The answer could not be verified against the source text.|Unsupported "
                          f"claims: ' || len(bad)::VARCHAR || '|{_NOTES}' ELSE CASE WHEN ni > 0 THEN "
                          f"ni::VARCHAR || ' citation issue(s) detected.|' ELSE '' END || '{_NOTES}' END "
                          f"AS warnings, CASE WHEN status = 'fail' THEN 'Verification failed. The "
                          f"answer contained ' || len(bad)::VARCHAR || ' unsupported claim(s). See "
                          f"/queries/' || query_id || '/retrieval-debug for details.' END AS error FROM "
                          f"verdict JOIN drafts USING (query_id) JOIN (SELECT query_id, count(*) AS nc, "
                          f"count(issue) AS ni FROM cited GROUP BY query_id) USING (query_id)",
        "final_response_errors": "SELECT query_id, CASE WHEN lost THEN 'fail' ELSE 'pass_with_warnings' END AS "
                                 "verification_status, CASE WHEN lost THEN 0 ELSE len(top) END::INTEGER AS "
                                 "n_citations, CASE WHEN lost THEN 0 ELSE 1 END AS n_warnings, CASE WHEN "
                                 f"lost THEN '{_NO_EVIDENCE}' END AS error FROM (SELECT *, "
                                 "query_id::INTEGER % 4 = 1 AS lost FROM top2)",
        "sweep_mixed_compat": "SELECT query_id, passage_id, true AS same_rank FROM rer",
        "grounding_metrics": "SELECT query_id, cvr::DOUBLE AS citation_validity_rate, round(csr, 6) AS "
                             "claim_support_rate, open::INTEGER AS unsupported_claim_count, status AS "
                             "verifier_status FROM grounded",
        "run_summary": "SELECT count(*) AS total, count_if(has)::BIGINT AS successful, count_if(NOT has)::BIGINT AS "
                       "failed, count_if(has AND hit_at_5 IS NOT NULL)::BIGINT AS n_with_gold, "
                       + ", ".join(f"round(avg({m}) FILTER (has), 4) AS {m}" for m in (
                           "hit_at_5", "hit_at_10", "hit_at_20", "recall_at_10", "precision_at_10",
                           "mrr"))
                       + ", round(avg(cvr), 4)::DOUBLE AS citation_validity_rate, round(avg(csr), 4) AS "
                         "claim_support_rate, round(avg(open), 2) AS avg_unsupported_claims FROM ("
                       + f"SELECT query_id, len(anchors) > 0 AS has, {_metric_columns(True)} FROM judged)"
                       + " LEFT JOIN grounded USING (query_id)",
        "failure_types": "SELECT query_id, h5 AS hit_at_5, hr AS hit_at_10, failed AS failure, kind AS "
                         "failure_type, len(g) > 0 AND NOT hl AND NOT hd AS miss_both, (hl OR hd) AND "
                         "NOT hm AS fusion_miss, array_to_string(r, ' ') AS retrieved_ids FROM fails",
        "sweep_summary": "SELECT label, count(*) AS n_questions, count_if(h5)::BIGINT AS n_hit_5, count_if(hr)::BIGINT "
                         "AS n_hit_10, count_if(miss)::BIGINT AS n_failures, count_if(miss AND NOT hl)::BIGINT AS "
                         "n_lexical_miss, count_if(miss AND hl AND NOT hd)::BIGINT AS n_dense_miss, "
                         "count_if(miss AND hl AND hd AND hm)::BIGINT AS n_rerank_miss, count_if(miss AND hl "
                         "AND hd AND NOT hm)::BIGINT AS n_unknown, count_if((hl OR hd) AND NOT hm)::BIGINT AS "
                         "n_fusion_miss FROM (SELECT *, len(g) > 0 AND NOT hr AS miss FROM sw_hits) "
                         "GROUP BY label",
        "model_run_summary": "SELECT 'synthetic' AS label, count(*) AS total_queries, 0::BIGINT AS "
                             "error_count, round(avg(h5::INT), 4) AS hit_at_5, round(avg(hr::INT), 4) "
                             "AS hit_at_10, count_if(failed)::BIGINT AS failure_count, count_if(fallback)::BIGINT AS "
                             "fallback_count, round(avg(fallback::INT), 4) AS fallback_rate, count(*) "
                             "AS verifier_fallback_count, 1.0::DOUBLE AS verifier_fallback_rate, "
                             "0.0::DOUBLE AS schema_success_rate, round(avg((NOT fallback)::INT), 4) AS "
                             "answer_schema_success_rate, 0.0::DOUBLE AS verifier_schema_success_rate, "
                             "0.0::DOUBLE AS average_retries_used, 0.0::DOUBLE AS "
                             "answer_average_retries_used, 0.0::DOUBLE AS "
                             "verifier_average_retries_used, count_if(n > 1 AND kind_no IN (1, 4))::BIGINT AS "
                             "repair_used_count, count_if(n > 1 AND kind_no = 1)::BIGINT AS repair_success_count FROM fails JOIN "
                             "(SELECT query_id, fallback, n, kind AS kind_no FROM drafts) "
                             "USING (query_id)",
        "json_validate": "SELECT query_id, attempt, stage AS failure_stage, tried AS "
                         "repair_attempted, mended AS repair_succeeded, CASE WHEN stage IS NULL THEN "
                         "text END AS final_answer FROM checked",
        "json_resolve": "SELECT query_id, count_if(stage IS NULL) > 0 AS success, count(*)::INTEGER AS "
                        "attempts, count_if(tried) > 0 AS repair_attempted, count_if(mended) > 0 AS "
                        "repair_succeeded, count_if(kind <> 7)::INTEGER AS n_outputs FROM checked JOIN "
                        "last_try USING (query_id) WHERE attempt <= n GROUP BY query_id",
        "latest_artifact": "SELECT query_id, turn, role, text FROM (SELECT conv_id::VARCHAR AS "
                           "query_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER "
                           "BY turn DESC) AS k FROM conversations) WHERE k = 1",
        "bm25_topk_saved": top.format(score="lexical_score", rank="rank_lexical", k=10,
                                      rows="bm WHERE score > 0"),
        "rerank_scorer": "SELECT query_id, passage_id, round(rs, 6) AS rerank_score, rr::INTEGER AS rank_rerank FROM ("
                         "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rh) - 1 AS rr FROM ("
                         "SELECT b.query_id, b.passage_id, b.rh, CASE WHEN lower(left(nq, 1)) IN ('a', 'e', 'i', 'o', 'u') "
                         f"THEN h ELSE round(len(list_intersect({letter_words('nq')}, {letter_words('text')})) / "
                         f"greatest(len({letter_words('nq')}), 1), 6) END AS rs FROM base b JOIN qs USING (query_id) "
                         "JOIN pas USING (passage_id) WHERE rh < 25))",
        "unit_rejects": "SELECT doc_id::VARCHAR AS document_id, count(*) AS n_lines, count_if(why = '')::BIGINT AS n_units, "
                        "count_if(why = 'blank')::BIGINT AS n_blank, count_if(why = 'short')::BIGINT AS n_short, "
                        "count_if(why = 'chapter')::BIGINT AS n_chapter FROM (SELECT doc_id, CASE WHEN trim(line, ' ') = '' "
                        "THEN 'blank' WHEN len(string_split(line, '|')) < 3 THEN 'short' WHEN try_cast(trim("
                        "string_split(line, '|')[1], ' ') AS INTEGER) IS NULL THEN 'chapter' ELSE '' END AS why FROM "
                        f"(SELECT doc_id, unnest(string_split(t, {NL})) AS line FROM unit_docs)) GROUP BY doc_id",
        "question_rejects": "WITH i AS (SELECT item_id, item_id // 10 AS g, item_id % 7 AS kind, text, row_number() OVER ("
                            "PARTITION BY item_id // 10 ORDER BY item_id) - 1 AS place FROM benchmark) SELECT "
                            "g::VARCHAR AS file, place::INTEGER AS place, CASE WHEN kind NOT IN (1, 2, 3) THEN item_id::VARCHAR "
                            "END AS query_id, CASE WHEN kind NOT IN (1, 2, 3) THEN text END AS question, CASE WHEN kind NOT "
                            "IN (1, 2, 3) THEN 'p1' END AS expected_ids, CASE kind WHEN 1 THEN 'question is missing' WHEN 2 THEN "
                            "'expected_relevant_passage_ids has the wrong type' WHEN 3 THEN 'no object' END AS reason "
                            "FROM i WHERE g % 4 <> 3 UNION ALL SELECT DISTINCT g::VARCHAR, NULL::INTEGER, NULL, NULL, NULL, "
                            "'no JSON' FROM i WHERE g % 4 = 3",
        "project_documents": "SELECT source AS project_id, count(*) AS n_documents, sum(length(text))::BIGINT AS n_chars FROM "
                             "documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY source "
                             "LIMIT 3) GROUP BY source",
        "stored_candidates": "SELECT query_id, passage_id, CASE WHEN rs <> 0 THEN rs ELSE h END AS raw_score, "
                             "rr::INTEGER AS rank FROM rer",
        "stored_results": "SELECT query_id, " + ", ".join(
            f"{m}_at_{k}" for k in (5, 10, 20) for m in ("hit", "recall", "precision"))
            + f", mrr, '1' AS label FROM (SELECT query_id, {_metric_columns(True)} FROM judged)",
        "failure_histogram": "SELECT 'shifted' AS label, kind AS failure_type, count(*) AS count FROM (SELECT CASE WHEN NOT "
                             "list_has_any(coalesce(l, []), b.g) THEN 'lexical_miss' WHEN NOT list_has_any(coalesce(d, []), "
                             "b.g) THEN 'dense_miss' WHEN list_has_any(coalesce(m, []), b.g) THEN 'rerank_miss' ELSE "
                             "'unknown' END AS kind FROM gold q JOIN gold b ON b.query_id::INTEGER + 1 = q.query_id::INTEGER "
                             "LEFT JOIN ids_l ON ids_l.query_id = q.query_id LEFT JOIN ids_d ON ids_d.query_id = q.query_id "
                             "LEFT JOIN ids_m ON ids_m.query_id = q.query_id LEFT JOIN ids_r ON ids_r.query_id = q.query_id "
                             "WHERE len(b.g) > 0 AND NOT list_has_any(coalesce(r, []), b.g)) GROUP BY kind",
        "model_reports": "SELECT query_id, CASE WHEN how = 'structured' THEN said ELSE status END AS status, CASE how WHEN "
                         "'skip' THEN 'deterministic_skip' WHEN 'lost' THEN 'deterministic_fallback' ELSE how END AS mode, "
                         "CASE WHEN how = 'skip' THEN 0 WHEN n IN (2, 3) THEN 3 ELSE 1 END::INTEGER AS attempts, "
                         "array_to_string(CASE WHEN how = 'structured' THEN every ELSE good END, ' ') AS supported, "
                         "array_to_string(CASE WHEN how <> 'structured' THEN bad WHEN n = 1 THEN [every[1]] ELSE [] END, ' ') "
                         "AS unsupported, CASE WHEN how = 'structured' THEN 1 ELSE ni END::INTEGER AS n_issues FROM model_said",
        "model_responses": "SELECT query_id, CASE WHEN how = 'structured' THEN said ELSE status END AS verification_status, "
                           "CASE WHEN how = 'structured' THEN said ELSE status END <> 'fail' AS answered FROM model_said",
        "correction_prompts": "SELECT query_id, attempt, stage AS failure_stage, true AS begins, true AS ends FROM checked "
                              "WHERE stage IN ('json_parse', 'schema_validation')",
        "retrieval_metrics_alternatives": f"SELECT query_id, {_metric_columns(True)} FROM (SELECT j.query_id, list_distinct("
                                          "list_concat(j.g, coalesce(o.g, []))) AS g, j.ids, j.anchors FROM judged j LEFT "
                                          "JOIN judged o ON o.query_id::INTEGER + 1 = j.query_id::INTEGER)",
        "query_overview": "SELECT query_id, question, CASE WHEN fallback THEN array_to_string(texts, "
                          "' ') ELSE t1 END AS final_answer, nc::INTEGER AS n_citations, status AS "
                          "verification_status FROM qs JOIN drafts USING (query_id) JOIN verdict USING "
                          "(query_id) JOIN (SELECT query_id, count(*) AS nc FROM cites GROUP BY "
                          "query_id) USING (query_id)",
    }
    queries["context_lost"] = (
        "SELECT query_id, 'lost-' || query_id AS passage_id, own AS anchor_text, 'Lost' AS section_title, NULL::INTEGER AS "
        "section_order_index, 'lost-' || query_id AS window_passage_ids, own AS window_text FROM (SELECT query_id, CASE WHEN "
        "query_id::INTEGER % 2 = 0 THEN question ELSE '' END AS own FROM qs)")
    queries["context_from_windows"] = (
        "SELECT query_id, passage_id, window_passage_ids, window_text FROM (" + queries["context_expand"] + ")")
    queries["stored_artifacts"] = "SELECT query_id, count(*)::INTEGER AS n_anchors, true AS recent FROM bun GROUP BY query_id"
    queries["objection_issues"] = (
        "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' | ' || text ELSE text || ' | open' END "
        "AS issues FROM conversations")
    queries["passage_windows_nested"] = queries["passage_windows"]
    queries["gold_many_quotes"] = (
        "SELECT DISTINCT query_id, passage_id FROM (SELECT DISTINCT query_id, l AS quote FROM qlines WHERE l <> '') "
        "JOIN pas ON contains(pas.text, quote)")
    queries["query_overview_rounds"] = (
        "SELECT o.*, with_text FROM (" + queries["query_overview"] + ") o JOIN (SELECT query_id, string_agg('true', ' ') "
        "AS with_text FROM cites GROUP BY query_id) USING (query_id)")
    queries["context_places"] = queries["context_expand"]
    queries["eval_run"] = queries["run_summary"]
    queries["eval_run_retrieval"] = (
        "SELECT * EXCLUDE (citation_validity_rate, claim_support_rate, avg_unsupported_claims) FROM ("
        + queries["run_summary"] + ")")
    return {name: _combined(sql) for name, sql in queries.items()}


def _combined(sql: str) -> str:
    """CTEs in front, merged with a WITH clause the statement may already have."""
    if sql.startswith("WITH "):
        body = sql[len("WITH "):]
        needed = _sql(sql)
        head = needed[: len(needed) - len(sql)]
        return head.rstrip() + ", " + body if head else sql
    return _sql(sql)
