"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_TOPK = """
WITH usable AS (
    SELECT row_number() OVER () AS row, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
    SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id,
           list_inner_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""

_MIXING = """
WITH counts AS (
    SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
    SELECT source, sum(n) OVER () * sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () / n AS rate FROM counts
), probability AS (
    SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
    FROM rates, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 21)::BIGINT)) AS t(k)
), cdf AS (
    SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS total FROM probability
), drawn AS (
    SELECT *, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)
           / 4503599627370496.0::DOUBLE AS u
    FROM documents
), repeated AS (
    SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u) AS copies
    FROM drawn d
)
SELECT doc_id, unnest(range(copies))::INTEGER AS copy, source, lang, n_chars, text FROM repeated
"""

_SET_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        END AS s
    FROM words
), tokens AS (
    SELECT row, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
    SELECT a.row AS a, b.row AS b
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.row <> b.row
    WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.row, b.row, a.n, b.n
    HAVING 190 * count(*) >= 90 * (a.n + b.n)
), reached AS (
    SELECT a AS row, b FROM links
    UNION
    SELECT r.row, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, (
    SELECT min(o.doc_id) FROM reached r JOIN sets o ON o.row = r.b WHERE r.row = sets.row
)) AS component_id
FROM sets
"""


def _nearest(book: str) -> str:
    """Entry and squared distance of each part under the codebooks of a table."""
    return f"""
    SELECT r.row, r.p, arg_min(b.entry, d * 64 + b.entry) AS entry, min(d) AS distance
    FROM rows_parts r JOIN {book} b ON b.p = r.p,
        LATERAL (SELECT (list_inner_product(r.x, r.x) - 2 * list_inner_product(r.x, b.x)
                         + list_inner_product(b.x, b.x))::BIGINT AS d)
    GROUP BY r.row, r.p
    """


def _means(near: str, book: str) -> str:
    """The codebooks after one round."""
    return f"""
    SELECT b.p, b.entry, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x
    FROM {book} b LEFT JOIN (
        SELECT p, entry, list(mean ORDER BY place) AS x FROM (
            SELECT n.p, n.entry, place, floor(sum(r.x[place])::DOUBLE / count(*)) AS mean
            FROM {near} n JOIN rows_parts r ON r.row = n.row AND r.p = n.p, range(1, len(r.x) + 1) AS t(place)
            GROUP BY n.p, n.entry, place
        ) GROUP BY p, entry
    ) m ON m.p = b.p AND m.entry = b.entry
    """


_CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), rows_parts AS MATERIALIZED (
    SELECT row, p, v[1 + p * (len(v) // 16) : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)
), first AS (
    SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept WHERE vec_id IS NOT NULL
    ORDER BY vec_id LIMIT 64
), book0 AS MATERIALIZED (SELECT r.p, f.entry, r.x FROM first f JOIN rows_parts r ON r.row = f.row),
near0 AS MATERIALIZED ({_nearest("book0")}), book1 AS MATERIALIZED ({_means("near0", "book0")}),
near1 AS MATERIALIZED ({_nearest("book1")}), book2 AS MATERIALIZED ({_means("near1", "book1")}),
near2 AS MATERIALIZED ({_nearest("book2")}),
coded AS (
    SELECT row, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error
    FROM near2 GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(component::BIGINT::VARCHAR, ',' ORDER BY p, entry, place))
     FROM (SELECT p, entry, unnest(x) AS component, generate_subscripts(x, 1) AS place FROM book2)) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""

_FILL_IN_MIDDLE = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
        sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM documents
), drawn AS (
    SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM cut
), formed AS (
    SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, lines,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
            THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), spans AS (
    SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
        array_to_string(lines[b + 1:n], '') AS suffix
    FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM spans
"""

ORACLES = {
    "op5_topk": _TOPK,
    "op7_mixing": _MIXING,
    "op11_set_join": _SET_JOIN,
    "op12_vector_codes": _CODES,
    "op13_fill_in_middle": _FILL_IN_MIDDLE,
}
