"""DuckDB SQL for the queries, written from the definitions rather than from the Spark code."""

from __future__ import annotations

# The time of the test documents, the prompts, and the characters that count as white space.
STAMP = "2024-01-01T00:00:00Z"
SUMMARY_PROMPT = "Please summarize the following text in 2-3 sentences:\n\n"
REWRITE_PROMPT = (
    "Rephrase or improve the following search query for better results, focusing on clarity and effectiveness. "
    "Return only the improved query, without any preamble or explanation. Original query: "
)
STRIP_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

_sql: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_sql)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(part.strip() for part in parts) + "\n"


def strip(text: str) -> str:
    return f"trim({text}, '{STRIP_CHARACTERS}')"


def decode(text: str) -> str:
    """The named references that occur in the pages; the ampersand comes last."""
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{character}', 'g')"
    return text


VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g')"
NODES = f"list_transform(string_split_regex({VISIBLE}, '<[^>]*>'), lambda x: {strip(decode('x'))})"
TITLE = strip(decode(f"regexp_extract({VISIBLE}, '(?is)<title[^>]*>(.*?)</title>', 1)"))
TEXT = f"array_to_string(list_filter({NODES}, lambda x: x <> ''), ' ')"
HREFS = f"""list_filter(list_transform(regexp_extract_all({VISIBLE}, '(?i)<a\\s[^>]*?href="([^"]*)"', 1),
    lambda x: {decode('x')}), lambda x: x <> '')"""
NETLOC = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def snippet(text: str) -> str:
    return f"CASE WHEN length({text}) > 200 THEN substring({text}, 1, 200) || '...' ELSE {text} END"


# One row per page: title, text, hrefs; links resolved and unique in order of first appearance.
PARSED = f"parsed AS (SELECT page_id, url, {TITLE} AS title, {TEXT} AS text, {HREFS} AS hrefs FROM pages)"
LINKS = f"""
links AS (
    SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY first_place) - 1 AS pos
    FROM (
        SELECT page_id, url, link, min(place) AS first_place
        FROM (SELECT page_id, url, {SITE} || unnest(hrefs) AS link, generate_subscripts(hrefs, 1) AS place FROM parsed)
        GROUP BY ALL
    )
)"""
STORE = """store AS (
    SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status,
        CASE WHEN page_id % 17 = 5 THEN '' ELSE html END AS html
    FROM pages
)"""
DOCUMENTS = f"""docs AS (
    SELECT url, title, text AS body, {snippet('text')} AS snippet, CAST(NULL AS VARCHAR) AS llm_summary,
        'crawler' AS source_engine, '{STAMP}' AS crawled_timestamp, page_id AS ingest_seq
    FROM parsed
)"""

# Sources and sinks

_sql["seed_source"] = """
SELECT url, 0 AS depth, row_number() OVER (ORDER BY page_id, n) AS pos
FROM pages, (VALUES (1), (2)) AS copies(n)
"""
_sql["page_fetch"] = _with(STORE) + """
SELECT w.url, CASE WHEN s.status = 200 THEN md5(s.html) END AS html_md5
FROM (SELECT url FROM pages UNION ALL SELECT url || '/missing' FROM pages) w LEFT JOIN store s ON w.url = s.url
"""
_sql["page_filter_unfetched"] = _with(STORE) + "SELECT url FROM store WHERE status = 200 AND html <> ''"
_sql["document_table"] = _with(PARSED, DOCUMENTS) + "SELECT * FROM docs"
RAW = """raw AS (
    SELECT CAST(floor(doc_id / 50) AS BIGINT) AS query_id, doc_id % 2 = 0 AS even, doc_id AS position,
        CASE WHEN lang <> 'de' THEN lang ELSE '' END AS title,
        CASE WHEN doc_id % 23 <> 0 THEN 'http://x/' || CAST(doc_id % 17 AS VARCHAR) ELSE '' END AS url,
        text AS snippet
    FROM documents
)"""
_sql["engine_source_ddg"] = _with(RAW) + """
SELECT query_id, position, title, url, md5(snippet) AS snippet_md5, 'duckduckgo' AS source_engine FROM raw
"""
_sql["document_lookup"] = _with(PARSED) + """
SELECT url, title, (SELECT count(*) FROM pages) AS documents FROM parsed WHERE url = (SELECT max(url) FROM pages)
"""

# URL expressions

_sql["url_parts"] = f"SELECT page_id, regexp_extract(url, '^[a-z]+') AS scheme, {NETLOC} AS netloc FROM pages"
_sql["url_valid"] = "SELECT page_id, url FROM pages"
_FORMS = ["?z=1", "#s", "//o.com/x", "mailto:a@b", "p.html", "../x", "HTTP://U.com/X", "https://o.com/a?b#c"]
_sql["url_resolve"] = _with(
    PARSED,
    f"""given AS (
    SELECT page_id, url, list_concat(hrefs, {_FORMS!r}) AS hrefs FROM parsed
)""",
    """exploded AS (
    SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM given
)""",
    f"""located AS (
    SELECT *, {SITE} AS site, {PATH} AS path, regexp_extract(url, '\\?[^#]*') AS asked,
        regexp_replace({PATH}, '[^/]*$', '') AS folder
    FROM exploded
)""",
) + """
SELECT page_id, pos, href,
    CASE
        WHEN href LIKE 'mailto:%' OR href LIKE 'https://%' THEN href
        WHEN href LIKE 'HTTP://%' THEN
            CASE WHEN url LIKE 'http://%' THEN 'http' || substring(href, 5) ELSE href END
        WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href
        WHEN href LIKE '/%' THEN site || href
        WHEN href LIKE '?%' THEN site || path || href
        WHEN href LIKE '#%' THEN site || path || asked || href
        WHEN href LIKE '../%' THEN site || regexp_replace(folder, '[^/]+/$', '') || substring(href, 4)
        ELSE site || folder || href
    END AS link
FROM located
"""
_sql["links_absolute_only"] = "SELECT page_id, url AS link FROM pages"

# HTML

_sql["html_title"] = f"SELECT page_id, {TITLE} AS title FROM pages"
_sql["html_text"] = f"SELECT page_id, {TEXT} AS text FROM pages"
_sql["html_links"] = _with(PARSED) + """
SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM parsed
"""
_sql["links_distinct"] = _with(PARSED, LINKS) + "SELECT page_id, pos, link FROM links"
_sql["link_edges"] = _with(PARSED, LINKS) + "SELECT url AS src_url, pos, link AS dst_url FROM links"
_sql["snippet"] = f"SELECT doc_id, {snippet('text')} AS snippet FROM documents"
_sql["page_parse"] = _with(PARSED) + f"""
SELECT page_id, url, title, text, {snippet('text')} AS snippet, len(list_distinct(hrefs)) AS links FROM parsed
"""

# An unclosed quote before the page takes in a tag; one behind it is never closed and stays text.
_sql["html_malformed"] = _with(PARSED) + f"""
SELECT page_id, title, 'rest ' || CASE WHEN text <> '' THEN text || ' ' ELSE '' END || '<a href="/never>left over' AS text,
    {SITE} || '/torn>gap <b title=' AS first_link, 1 + len(list_distinct(hrefs)) AS links
FROM parsed
"""

# Robots: the grammar is followed line by line.


def _answers(status: str) -> str:
    return f"""answers AS (
    SELECT netloc, page_id AS seq, {status} AS status,
        '# rules of ' || netloc || chr(10) || 'User-agent: otherbot' || chr(10) || 'User-agent: '
        || CASE WHEN page_id % 3 = 0 THEN 'nobot' ELSE 'fetch' END || chr(10) || 'Disallow: ' || path || chr(10)
        || 'Crawl-delay: 5' || chr(10) || chr(10) || 'user-agent: *' || chr(10) || 'Allow: ' || path
        || ' # own page' || chr(10) || 'DISALLOW: ' || regexp_extract(path, '^/[^/]*') || '/' || chr(10)
        || 'Disallow:' || chr(10) AS text
    FROM (SELECT page_id, {NETLOC} AS netloc, {PATH} AS path FROM pages)
)"""


_STATUS = "CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END"
_HOSTS = "hosts AS (SELECT netloc, min_by(text, seq) AS text FROM answers WHERE status = 200 GROUP BY netloc)"
_RULES = (
    """lines AS (
    SELECT netloc, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM hosts
)""",
    """events AS (
    SELECT netloc, line_no, line, lower(trim(split_part(split_part(line, '#', 1), ':', 1))) AS key,
        trim(regexp_replace(split_part(line, '#', 1), '^[^:]*:', '')) AS value
    FROM lines WHERE line = '' OR split_part(line, '#', 1) LIKE '%:%'
)""",
    """steps AS (
    SELECT *, lag(key) OVER (PARTITION BY netloc ORDER BY line_no) AS before FROM events
)""",
    """groups AS (
    SELECT *, sum(CASE WHEN key = 'user-agent' AND before IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END)
        OVER (PARTITION BY netloc ORDER BY line_no) AS group_seq
    FROM steps
)""",
    """group_agents AS (
    SELECT netloc, group_seq, list(value ORDER BY line_no) AS agents
    FROM groups WHERE key = 'user-agent' GROUP BY ALL
)""",
    """rules AS (
    SELECT netloc, CAST(group_seq AS BIGINT) AS group_seq, agents,
        row_number() OVER (PARTITION BY netloc, group_seq ORDER BY line_no) - 1 AS rule_seq,
        CASE WHEN key <> 'crawl-delay' THEN key = 'allow' OR value = '' END AS allow,
        CASE WHEN key <> 'crawl-delay' THEN value END AS path
    FROM groups JOIN group_agents USING (netloc, group_seq)
    WHERE key IN ('allow', 'disallow', 'crawl-delay')
)""",
)
_CHOSEN = """chosen AS (
    SELECT netloc, min_by(group_seq, order_key) AS group_seq
    FROM (
        SELECT netloc, group_seq, CASE WHEN list_contains(agents, '*') THEN 1000 ELSE 0 END + group_seq AS order_key
        FROM rules
        WHERE list_contains(agents, '*') OR len(list_filter(agents, lambda a: contains('fetchbot', lower(a)))) > 0
    )
    GROUP BY netloc
)"""
_DECISIONS = """decisions AS (
    SELECT url, coalesce(min_by(allow, rule_seq), true) AS allowed
    FROM (
        SELECT p.url, r.allow, r.rule_seq
        FROM (SELECT url, NETLOC AS netloc, PATH AS path FROM pages) p
        LEFT JOIN (SELECT rules.* FROM rules JOIN chosen USING (netloc, group_seq) WHERE path IS NOT NULL) r
            ON p.netloc = r.netloc AND starts_with(p.path, r.path)
    )
    GROUP BY url
)""".replace("NETLOC", NETLOC).replace("PATH AS", f"{PATH} AS")
_ROBOTS = (_answers(_STATUS), _HOSTS, *_RULES, _CHOSEN, _DECISIONS)
_FAILING = f"CASE WHEN length(netloc) % 2 = 0 THEN 503 ELSE {_STATUS} END"

_sql["robots_hosts"] = _with(_answers(_STATUS), _HOSTS) + "SELECT netloc, text FROM hosts"
_sql["robots_rules"] = _with(_answers(_STATUS), _HOSTS, *_RULES) + """
SELECT netloc, group_seq, array_to_string(agents, ',') AS agents, rule_seq, allow, path FROM rules
"""
_sql["robots_allowed"] = _with(*_ROBOTS) + "SELECT url, allowed FROM decisions"
_sql["robots_fail_open"] = _with(_answers(_FAILING), _HOSTS, *_RULES, _CHOSEN, _DECISIONS) + """
SELECT url, allowed FROM decisions
"""
_sql["disallowed_filter"] = _with(STORE, *_ROBOTS) + """
SELECT url, CASE WHEN status = 200 THEN md5(html) END AS html_md5 FROM store JOIN decisions USING (url) WHERE allowed
"""

# Crawl

_PAGE_LINKS = """page_links AS (
    SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(place)) - 1 AS idx
    FROM (
        SELECT page_id, url, link, pos AS place FROM links
        UNION ALL
        SELECT p.page_id, p.url, o.url, 1000000 + k
        FROM pages p, (VALUES (1), (2), (3)) AS ks(k), pages o
        WHERE o.page_id = (p.page_id * 7 + k) % (SELECT count(*) FROM pages)
    )
    GROUP BY page_id, url, link
)"""
_GOOD_LINKS = "good_links AS (SELECT l.* FROM page_links l JOIN store s USING (page_id) WHERE s.status = 200)"
_WAVE0 = f"""w0 AS (
    SELECT url, 0 AS depth, 0 AS wave, row_number() OVER (ORDER BY page_id) AS pos
    FROM (SELECT min(page_id) AS page_id, min_by(url, page_id) AS url FROM pages GROUP BY {NETLOC})
)"""


def _wave(n: int) -> str:
    earlier = " UNION ALL ".join(f"SELECT url FROM w{k}" for k in range(n))
    before = " + ".join(f"(SELECT count(*) FROM w{k})" for k in range(n))
    return f"""w{n} AS (
    SELECT url, {n} AS depth, {n} AS wave, {before} + row_number() OVER (ORDER BY parent_pos, idx) AS pos
    FROM (
        SELECT l.link AS url, min(w.pos) AS parent_pos, arg_min(l.idx, w.pos) AS idx
        FROM w{n - 1} w JOIN good_links l ON w.url = l.url
        WHERE l.link NOT IN ({earlier})
        GROUP BY l.link
    )
)"""


def _visited(depth: int) -> str:
    waves = " UNION ALL ".join(f"SELECT * FROM w{n}" for n in range(depth + 1))
    return f"""enqueued AS ({waves}), visited AS (
    SELECT e.*, e.url IN (SELECT url FROM store WHERE status = 200) AS ok FROM enqueued e
)"""


def _crawled(depth: int) -> str:
    waves = [_WAVE0, *[_wave(n) for n in range(1, depth + 1)]]
    return _with(PARSED, LINKS, STORE, _PAGE_LINKS, _GOOD_LINKS, *waves, _visited(depth))


_sql["crawl_bfs"] = _crawled(3) + "SELECT url, depth, wave, pos, ok FROM visited"
_sql["crawl_depth_bound"] = _crawled(1) + "SELECT url, depth FROM visited"
_sql["crawl_page_budget"] = _crawled(3) + "SELECT url, pos, ok FROM visited WHERE pos <= 100"
_sql["crawl_visited_dedup"] = _with(PARSED, LINKS, STORE, _PAGE_LINKS, _GOOD_LINKS) + """
SELECT DISTINCT link AS url FROM good_links WHERE link NOT IN (SELECT url FROM store WHERE status = 404)
"""
_FIRST = """first_places AS (
    SELECT link AS url, min(page_id) AS parent_pos, 0 AS kind, arg_min(idx, page_id) AS idx, 1 AS depth
    FROM good_links GROUP BY link
)"""
_sql["crawl_queue_dedup"] = _with(PARSED, LINKS, STORE, _PAGE_LINKS, _GOOD_LINKS, _FIRST) + """
SELECT url, parent_pos, kind, idx, depth FROM first_places
"""
_sql["crawl_order"] = _with(PARSED, LINKS, STORE, _PAGE_LINKS, _GOOD_LINKS, _FIRST) + """
SELECT url, row_number() OVER (ORDER BY parent_pos, idx) AS pos FROM first_places
"""
_sql["crawl_documents"] = _with(PARSED, DOCUMENTS) + "SELECT * FROM docs"
# The queue holds what the processed pages enqueued and the budget did not reach: a page of the
# wave in which the budget ends enqueues its links only if it is itself within the budget.
_sql["crawl_stats"] = _crawled(2) + """
, done AS (SELECT * FROM visited WHERE pos <= 100),
left_over AS (
    SELECT url FROM visited WHERE pos > 100 AND wave <= (SELECT max(wave) FROM done)
    UNION
    SELECT l.link FROM good_links l JOIN done d ON d.url = l.url
    WHERE d.depth < 2 AND d.wave = (SELECT max(wave) FROM done)
        AND l.link NOT IN (SELECT url FROM visited WHERE wave <= (SELECT max(wave) FROM done))
)
SELECT (SELECT count(*) FROM done) AS pages_visited, (SELECT count(*) FROM done WHERE ok) AS pages_good,
    (SELECT count(*) FROM left_over) AS urls_queued
"""
# Each round sees the whole queue so far: the last wave as queue, all of it as recurring.queue.
_sql["crawl_seed_expansion"] = _with(PARSED, LINKS, STORE, _PAGE_LINKS, _GOOD_LINKS, _WAVE0, """found AS (
    SELECT p.url, 0 AS idx, 'http://found.example.org/' || CAST(p.page_id AS VARCHAR) AS target FROM pages p
    UNION ALL
    SELECT p.url, 1, o.url FROM pages p JOIN pages o
        ON o.page_id = (p.page_id * 3 + 1) % (SELECT count(*) FROM pages)
)""", """queue(url, depth, wave, pos) USING KEY (url) AS (
    SELECT url, depth, wave, pos FROM w0
    UNION
    SELECT url, depth, wave, (SELECT max(pos) FROM recurring.queue) + row_number() OVER (ORDER BY place) AS pos
    FROM (
        SELECT url, arg_min(depth, place) AS depth, min(wave) AS wave, min(place) AS place
        FROM (
            SELECT l.link AS url, q.depth + 1 AS depth, q.wave + 1 AS wave, (q.pos * 2) * 2000000 + l.idx AS place
            FROM queue q JOIN good_links l ON l.url = q.url WHERE q.depth < 1
            UNION ALL
            SELECT f.target, 0, q.wave + 1, (q.pos * 2 + 1) * 2000000 + f.idx
            FROM queue q
            JOIN (
                SELECT r.url, row_number() OVER (ORDER BY r.pos) AS n
                FROM recurring.queue r JOIN store s ON s.url = r.url WHERE s.status = 200
            ) good ON good.url = q.url
            JOIN found f ON f.url = q.url
            WHERE good.n % 5 = 0
        )
        WHERE url NOT IN (SELECT url FROM recurring.queue)
        GROUP BY url
    )
)""") + """
SELECT url, depth, wave, pos, url IN (SELECT url FROM store WHERE status = 200) AS ok FROM queue
"""
_sql["crawl_meta_trigger"] = _with(STORE) + """
SELECT * FROM (
    SELECT url, page_id AS pos, row_number() OVER (ORDER BY page_id) AS n FROM store WHERE status = 200 AND html <> ''
) WHERE n % 20 = 0
"""
_sql["crawl_meta_query"] = f"""
SELECT page_id, CASE
    WHEN page_id % 4 = 0 THEN url
    WHEN page_id % 3 <> 0 AND {TITLE} <> '' THEN {TITLE}
    ELSE 'http://seed.example.org/' END AS query
FROM pages
"""

# Document table

VERSIONS = f"""versions AS (
    SELECT CASE WHEN user_id % 100 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS url, event_type AS title,
        props AS body, 'event ' || CAST(event_id AS VARCHAR) AS snippet,
        CASE WHEN event_id % 2 = 0 THEN event_type END AS llm_summary, 'crawler' AS source_engine,
        '{STAMP}' AS crawled_timestamp, event_id AS ingest_seq
    FROM events
)"""
LATEST = """latest AS (
    SELECT * FROM versions v
    WHERE url IS NULL OR ingest_seq = (SELECT max(ingest_seq) FROM versions o WHERE o.url = v.url)
)"""
_BODY = "CASE WHEN event_id % 5 > 1 THEN CAST(event_id AS VARCHAR) END"
_sql["doc_required_filter"] = f"""
SELECT event_id, CAST(event_id AS VARCHAR) AS url, event_type AS title, {_BODY} AS body, 's' AS snippet,
    CAST(NULL AS VARCHAR) AS llm_summary, 'e' AS source_engine, 'c' AS crawled_timestamp
FROM events WHERE event_id % 5 <> 0
"""
_sql["doc_upsert"] = _with(
    VERSIONS,
    """ordered AS (
    SELECT * REPLACE (CASE WHEN title = 'view' THEN ingest_seq ELSE ingest_seq + 1000000000000 END AS ingest_seq)
    FROM versions
)""",
) + """
SELECT * FROM ordered v
WHERE url IS NULL OR ingest_seq = (SELECT max(ingest_seq) FROM ordered o WHERE o.url = v.url)
"""
_sql["doc_upsert_batch"] = _with(VERSIONS, LATEST) + "SELECT * FROM latest"
_sql["doc_batch_count"] = "SELECT count(*) AS processed FROM events WHERE event_id % 5 <> 0"
_sql["doc_batch_atomic"] = _sql["doc_upsert_batch"]
_sql["doc_stream_upsert"] = _sql["doc_upsert_batch"]
_sql["doc_delete"] = _with(VERSIONS, LATEST) + """
SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.title = 'error' AND v.url = l.url)
"""

# Full-text search


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_sql["ft_tokenize"] = f"""
SELECT token, count(*) AS occurrences, max(doc_id) AS last_doc
FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token
"""
TEXTS = f"""texts AS (
    SELECT 'http://d/' || CAST(doc_id AS VARCHAR) AS url, lang AS title, text AS body, {snippet('text')} AS snippet,
        CAST(NULL AS VARCHAR) AS llm_summary, source AS source_engine, '{STAMP}' AS crawled_timestamp,
        doc_id AS ingest_seq
    FROM documents
)"""
_COLUMNS = ["title", "body", "snippet", "llm_summary", "source_engine", "crawled_timestamp"]


def _indexed(documents: str) -> tuple[str, ...]:
    columns = " UNION ALL ".join(
        f"SELECT ingest_seq AS doc_id, {n} AS col, {tokens(name)} AS words FROM {documents} WHERE {name} IS NOT NULL"
        for n, name in enumerate(_COLUMNS)
    )
    return (
        f"columns_ AS ({columns})",
        """words AS (
    SELECT doc_id, col, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM columns_
)""",
        "lengths AS (SELECT doc_id, CAST(sum(len(words)) AS BIGINT) AS dl FROM columns_ GROUP BY doc_id)",
        "corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)",
    )


PAGE_INDEX = (PARSED, DOCUMENTS, *_indexed("docs"))
TEXT_INDEX = (TEXTS, *_indexed("texts"))

_sql["ft_postings"] = _with(*PAGE_INDEX) + """
SELECT term, w.doc_id, dl, count(*) AS tf,
    string_agg(CAST(col * 4294967296 + pos AS VARCHAR), ',' ORDER BY col, pos) AS places
FROM words w JOIN lengths USING (doc_id) GROUP BY term, w.doc_id, dl
UNION ALL SELECT '', doc_id, dl, 1, '-4294967296' FROM lengths
"""
_sql["ft_corpus_stats"] = _with(*TEXT_INDEX) + """
SELECT term, count(DISTINCT doc_id) AS df, (SELECT n FROM corpus) AS documents,
    (SELECT round(avgdl, 6) FROM corpus) AS average_length
FROM words GROUP BY term
"""

# Every seventh page is replaced by a document whose body is its title.
_REPLACED = """after AS (
    SELECT * FROM docs WHERE ingest_seq % 7 <> 0
    UNION ALL
    SELECT * REPLACE (title AS body, ingest_seq + (SELECT max(ingest_seq) + 1 FROM docs) AS ingest_seq)
    FROM docs WHERE ingest_seq % 7 = 0
)"""
_sql["ft_index_update"] = _with(PARSED, DOCUMENTS, _REPLACED, *_indexed("after")) + """
SELECT term, w.doc_id, dl, count(*) AS tf,
    string_agg(CAST(col * 4294967296 + pos AS VARCHAR), ',' ORDER BY col, pos) AS places
FROM words w JOIN lengths USING (doc_id) GROUP BY term, w.doc_id, dl
UNION ALL SELECT '', doc_id, dl, 1, '-4294967296' FROM lengths
"""
_sql["ft_term_dictionary"] = _with(*PAGE_INDEX) + """
SELECT term, count(DISTINCT doc_id) AS df, 1 AS buckets FROM words WHERE starts_with(term, 'th') GROUP BY term
"""


def _phrase(name: str, hits: str, counted: str | None = None) -> str:
    """Scores of one phrase; ``hits`` selects (doc_id, tf), ``counted`` the documents of df."""
    return f"""{name}_hits AS ({hits}), {name}_df AS (SELECT count(DISTINCT doc_id) AS df FROM ({counted or hits})),
{name} AS (
    SELECT doc_id, greatest_idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
    FROM {name}_hits JOIN lengths USING (doc_id), corpus,
        (SELECT CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
            AS greatest_idf FROM corpus, {name}_df)
)"""


def _term(name: str, term: str, where: str = "true") -> str:
    return _phrase(name, f"SELECT doc_id, count(*) AS tf FROM words WHERE term = '{term}' AND {where} GROUP BY doc_id")


_RANK = "SELECT doc_id, round(-sum(score), 6) AS rank FROM"


def _search(phrases: list[str], body: str) -> str:
    return _with(*PAGE_INDEX, *phrases) + body


_sql["ft_match_term"] = _search([_term("a", "was")], f"{_RANK} a GROUP BY doc_id")
_sql["ft_match_all"] = _search(
    [_term("a", "tion"), _term("b", "ble")],
    "SELECT doc_id, round(-(a.score + 2 * b.score), 6) AS rank FROM a JOIN b USING (doc_id)",
)
_UNION = "(SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"
_sql["ft_match_any"] = _search(
    [_term("a", "tion"), _term("b", "der"), _term("c", "crawler")], f"{_RANK} {_UNION} GROUP BY doc_id"
)
_sql["ft_match_not"] = _search(
    [_term("a", "this"), _term("b", "with")],
    f"{_RANK} a WHERE doc_id NOT IN (SELECT doc_id FROM b) GROUP BY doc_id",
)
_sql["ft_match_phrase"] = _search(
    [
        _phrase(
            "a",
            """SELECT x.doc_id, count(*) AS tf FROM words x JOIN words y
            ON x.doc_id = y.doc_id AND x.col = y.col AND y.pos = x.pos + 1
            WHERE x.term = 'of' AND y.term = 'the' GROUP BY x.doc_id""",
        )
    ],
    f"{_RANK} a GROUP BY doc_id",
)
_sql["ft_match_prefix"] = _search(
    [_phrase("a", "SELECT doc_id, count(*) AS tf FROM words WHERE starts_with(term, 'tha') GROUP BY doc_id")],
    f"{_RANK} a GROUP BY doc_id",
)


def _near(name: str, term: str, other: str) -> str:
    near = f"""SELECT x.doc_id, count(DISTINCT (x.col, x.pos)) AS tf FROM words x JOIN words y
        ON x.doc_id = y.doc_id AND x.col = y.col AND abs(y.pos - x.pos) - 1 <= 4
        WHERE x.term = '{term}' AND y.term = '{other}' GROUP BY x.doc_id"""
    return _phrase(name, near, f"SELECT doc_id FROM words WHERE term = '{term}'")


_sql["ft_match_near"] = _search(
    [_near("a", "was", "that"), _near("b", "that", "was")],
    f"{_RANK} (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id",
)
_sql["ft_match_column"] = _search([_term("a", "la", "col IN (0, 2)")], f"{_RANK} a GROUP BY doc_id")
_sql["ft_match_initial"] = _search([_term("a", "the", "pos = 0")], f"{_RANK} a GROUP BY doc_id")
_sql["ft_bm25"] = _search(
    [_term("a", "la"), _term("b", "que"), _term("c", "thon")],
    f"""{_RANK} (
    SELECT * FROM a WHERE doc_id IN (SELECT doc_id FROM b)
    UNION ALL SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM a)
    UNION ALL SELECT * FROM c
) GROUP BY doc_id""",
)
_sql["ft_topk"] = _search(
    [_term("a", "thon")],
    "SELECT doc_id, round(-score, 6) AS rank FROM a ORDER BY -score, doc_id LIMIT 10",
)
_sql["ft_hit_projection"] = _search(
    [_term("a", "the"), _term("b", "tion")],
    """SELECT url, title, snippet, llm_summary, source_engine, crawled_timestamp,
    round(-(a.score + b.score), 6) AS rank
FROM a JOIN b USING (doc_id) JOIN docs ON docs.ingest_seq = doc_id
ORDER BY -(a.score + b.score), doc_id LIMIT 10""",
)
_sql["ft_search_batch"] = _with(
    *TEXT_INDEX,
    f"""wanted AS (
    SELECT item_id AS query_id, term, count(*) AS weight
    FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL
)""",
    "needed AS (SELECT query_id, count(*) AS terms FROM wanted GROUP BY query_id)",
    "tfs AS (SELECT term, doc_id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL)",
    """weights AS (
    SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf
    FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus
)""",
    """matched AS (
    SELECT query_id, doc_id, count(*) AS found,
        sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
    GROUP BY query_id, doc_id
)""",
) + """
SELECT query_id, doc_id, round(-score, 6) AS rank,
    row_number() OVER (PARTITION BY query_id ORDER BY round(-score, 9), doc_id) AS position
FROM matched JOIN needed USING (query_id) WHERE found = terms
QUALIFY position <= 10
"""


# The whole crawl, twice: waves of seeds and of what every fifth good page finds by a search.
def _job(name: str, seeds: str) -> tuple[str, ...]:
    return (
        f"""{name}_queue(url, wave, pos) USING KEY (url) AS (
    SELECT url, 0 AS wave, row_number() OVER (ORDER BY page_id) AS pos
    FROM store WHERE status = 200 AND page_id % {seeds} = 0
    UNION
    SELECT url, wave, (SELECT max(pos) FROM recurring.{name}_queue) + row_number() OVER (ORDER BY place) AS pos
    FROM (
        SELECT o.url, q.wave + 1 AS wave, min(q.pos) AS place
        FROM {name}_queue q
        JOIN (
            SELECT r.url, row_number() OVER (ORDER BY r.pos) AS n
            FROM recurring.{name}_queue r JOIN content USING (url)
        ) good ON good.url = q.url
        JOIN content c ON c.url = q.url
        JOIN pages o ON o.page_id = (q.pos * 3 + length(
            CASE WHEN contains(c.asked, '?') OR length('{REWRITE_PROMPT}' || c.asked) % 7 = 0 THEN c.asked
            ELSE 'None: ' || CAST(length('{REWRITE_PROMPT}' || c.asked) AS VARCHAR) || ' characters' END
        )) % (SELECT count(*) FROM pages)
        WHERE good.n % 5 = 0 AND o.url NOT IN (SELECT url FROM recurring.{name}_queue)
        GROUP BY o.url, q.wave
    )
)""",
        f"{name} AS (SELECT c.*, q.pos FROM {name}_queue q JOIN content c USING (url))",
    )


_SUMMARY = f"""CASE WHEN text = '' OR contains('{SUMMARY_PROMPT}' || substring(text, 1, 2000), '?')
    OR length('{SUMMARY_PROMPT}' || substring(text, 1, 2000)) % 7 = 0 THEN NULL
    ELSE 'None: ' || CAST(length('{SUMMARY_PROMPT}' || substring(text, 1, 2000)) AS VARCHAR) || ' characters' END"""
_CONTENT = f"""content AS (
    SELECT url, title, text, llm_summary,
        coalesce(llm_summary, nullif(title, ''), (SELECT min_by(url, page_id) FROM store WHERE status = 200 AND page_id % 3 = 0)) AS asked
    FROM (
        SELECT url, title, text, {_SUMMARY} AS llm_summary
        FROM parsed JOIN store USING (url) JOIN decisions USING (url) WHERE status = 200 AND html <> '' AND allowed
    )
)"""
_sql["crawl_job"] = _with(
    PARSED,
    STORE,
    *_ROBOTS,
    _CONTENT,
    *_job("job_one", "3"),
    *_job("job_two", "6"),
    f"""docs AS (
    SELECT url, title, text AS body, {snippet('text')} AS snippet, llm_summary, 'crawler' AS source_engine,
        '{STAMP}' AS crawled_timestamp, ingest_seq
    FROM (
        SELECT * REPLACE (pos + (SELECT max(pos) FROM job_one) AS pos), pos + (SELECT max(pos) FROM job_one) AS ingest_seq FROM job_two
        UNION ALL
        SELECT *, pos FROM job_one WHERE url NOT IN (SELECT url FROM job_two)
    )
)""",
    *_indexed("docs"),
) + "SELECT docs.* REPLACE (md5(body) AS body), doc_id, dl FROM docs JOIN lengths ON doc_id = ingest_seq"

# Meta-search

RESULTS = """results AS (
    SELECT query_id, position, title, url, snippet, CASE WHEN even THEN 'google' ELSE 'duckduckgo' END AS source_engine,
        CASE WHEN even THEN 0 ELSE 1 END AS engine_seq
    FROM raw
)"""
LIMITED = """limited AS (
    SELECT * FROM results
    QUALIFY row_number() OVER (PARTITION BY query_id, source_engine ORDER BY position) <= 10
)"""
_SHOWN = "SELECT query_id, position, title, url, md5(snippet) AS snippet, source_engine, engine_seq FROM"
_FIRST_RESULT = "QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY engine_seq, position) = 1"
_sql["meta_engine_select"] = _with(RAW, RESULTS) + f"{_SHOWN} results WHERE source_engine = 'duckduckgo'"
_sql["meta_per_engine_limit"] = _with(RAW, RESULTS, LIMITED) + f"{_SHOWN} limited"
_sql["meta_union"] = _with(RAW, RESULTS) + f"{_SHOWN} results"
_sql["meta_url_filter"] = _with(RAW, RESULTS) + f"{_SHOWN} results WHERE url <> ''"
_sql["meta_dedup_first"] = _with(RAW, RESULTS) + f"{_SHOWN} results WHERE url <> '' {_FIRST_RESULT}"
_sql["meta_counts"] = _with(RAW, RESULTS, LIMITED) + """
SELECT query_id, count(*) FILTER (source_engine = 'google') AS google_results,
    count(*) FILTER (source_engine = 'duckduckgo') AS duckduckgo_results,
    count(DISTINCT url) FILTER (url <> '') AS unique_results
FROM limited GROUP BY query_id
"""
_sql["meta_search_batch"] = _with(RAW, RESULTS, LIMITED) + f"{_SHOWN} limited WHERE url <> '' {_FIRST_RESULT}"

# Text generation

_sql["llm_messages"] = """
SELECT conv_id, turn, 0 AS pos, 'system' AS role, 'speak as assistant' AS content
FROM conversations WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, 'user', text FROM conversations
"""


def _answer(content: str) -> str:
    return f"""CASE WHEN contains({content}, '?') OR length({content}) % 7 = 0 THEN NULL
        ELSE 'stub: ' || CAST(length({content}) AS VARCHAR) || ' characters' END"""


_sql["llm_generate"] = f"SELECT conv_id, turn, {_answer('text')} AS answer FROM conversations"
_sql["llm_summary"] = _with(
    PARSED,
    f"asked AS (SELECT page_id, CASE WHEN text <> '' THEN '{SUMMARY_PROMPT}' || substring(text, 1, 2000) END AS prompt FROM parsed)",
) + f"SELECT page_id, {_answer('prompt')} AS llm_summary, md5(prompt) AS prompt_md5 FROM asked"
_REWRITE = f"'{REWRITE_PROMPT}' || text"
_sql["meta_search_rewritten"] = _with(
    RAW,
    f"asked AS (SELECT item_id AS query_id, coalesce({_answer(f'({_REWRITE})')}, text) AS query FROM benchmark)",
    """results AS (
    SELECT a.query_id, position, title, url, snippet, CASE WHEN even THEN 'google' ELSE 'duckduckgo' END AS source_engine,
        CASE WHEN even THEN 0 ELSE 1 END AS engine_seq
    FROM asked a JOIN raw r ON r.query_id = (a.query_id + length(a.query)) % (SELECT max(query_id) + 1 FROM raw)
)""",
    LIMITED,
) + f"{_SHOWN} limited WHERE url <> '' {_FIRST_RESULT}"
_sql["query_enhance_prompt"] = f"SELECT item_id, '{REWRITE_PROMPT}' || text AS prompt FROM benchmark"
_sql["query_enhance_fallback"] = f"""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'better ' || {strip('text')} ELSE text END AS query
FROM conversations
"""
