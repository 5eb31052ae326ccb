"""SQL counterparts of the registered queries of this package, for DuckDB."""

from __future__ import annotations


# DuckDB has no base32; SHA-1 is cut into 32 groups of five bits.
_BASE32 = """array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i + j + 1 AS INTEGER), 1) AS INTEGER)
        * (16 >> CAST(j AS INTEGER))))::INTEGER, 1)), '')"""

WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(
        strpos('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1), 4)), '') AS bits,
    count(*) OVER same AS n, max(page_id) OVER same AS first
    FROM d WINDOW same AS (PARTITION BY h))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN n > 1 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND first <> page_id THEN first END AS refers_to
FROM b"""


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
t AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, t),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // n_terms) AS m FROM d, t WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""


def oracles() -> dict[str, str]:
    return {"op3_warc_salvage": WARC, "op13_ranked_search": RANKED}
