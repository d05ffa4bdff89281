"""Matching and ranking against an independent full-text engine on random corpora."""

import random
import sqlite3

import pytest

from trawlight.operators.documents import latest_per_url, replaced_documents, upsert
from trawlight.operators.index import (
    build_index, corpus_stats, document_frequencies, prefix_postings, read_index, store_index, update_index, updated_index,
    write_index,
)
from trawlight.operators.match import (
    match_all, match_any, match_near, match_not, match_phrase, match_prefix, match_term,
)
from trawlight.operators.search import ranked, search, search_batch
from trawlight.schemas import SEARCH_HIT, STORED_DOCUMENT

ENGINE_TABLE = """create virtual table pages using fts5(url unindexed, title, body, snippet, llm_summary, source_engine,
crawled_timestamp, tokenize = "unicode61 remove_diacritics 2")"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    vocabulary = [*"abcdefghij", "apple", "apply", "app", "zebra", "Café", "日本語", "straße"]

    def words(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, n)))

    rows = [
        (f"u{n}", words(3), words(15), words(4), words(3) if n % 3 else None, "crawler", f"2024-01-0{n % 9 + 1}T00:00:00Z", n)
        for n in range(1, 121)
    ]
    engine = sqlite3.connect(":memory:")
    engine.execute(ENGINE_TABLE)
    engine.executemany(
        "insert into pages(url, title, body, snippet, llm_summary, source_engine, crawled_timestamp, rowid)"
        " values (?, ?, ?, ?, ?, ?, ?, ?)",
        rows,
    )
    engine.commit()
    documents = spark.createDataFrame(rows, STORED_DOCUMENT)
    path = str(tmp_path_factory.mktemp("index"))
    write_index(documents, f"{path}/index", buckets=8, range_rows=50)
    return engine, documents, read_index(spark, f"{path}/index")


def t(index, word, **options):
    return match_term(index, word, **options)


CASES = {
    "apple": lambda i: t(i, "apple"),
    "a b": lambda i: match_all(t(i, "a"), t(i, "b")),
    "zebra zebra": lambda i: match_all(t(i, "zebra"), t(i, "zebra")),
    "a OR zebra": lambda i: match_any(t(i, "a"), t(i, "zebra")),
    "a NOT zebra": lambda i: match_not(t(i, "a"), t(i, "zebra")),
    '"a b"': lambda i: match_phrase(i, "a b"),
    '"a b c"': lambda i: match_phrase(i, "a b c"),
    "app*": lambda i: match_prefix(i, "app"),
    "title : app*": lambda i: match_prefix(i, "app", columns=["title"]),
    "title : a": lambda i: t(i, "a", columns=["title"]),
    "{title body} : a": lambda i: t(i, "a", columns=["title", "body"]),
    "- title : a": lambda i: t(i, "a", excluded=["title"]),
    '{title body} : "a b"': lambda i: match_phrase(i, "a b", columns=["title", "body"]),
    "^a": lambda i: t(i, "a", initial=True),
    "(a b) OR zebra": lambda i: match_any(match_all(t(i, "a"), t(i, "b")), t(i, "zebra")),
    "(a b) NOT (zebra OR c)": lambda i: match_not(
        match_all(t(i, "a"), t(i, "b")), match_any(t(i, "zebra"), t(i, "c"))
    ),
    "crawler": lambda i: t(i, "crawler"),
    "2024": lambda i: t(i, "2024"),
    "cafe": lambda i: t(i, "CAFÉ"),
    "strasse": lambda i: t(i, "strasse"),
    "日本": lambda i: t(i, "日本"),
    "u1": lambda i: t(i, "u1"),
    "nonexistentterm123xyz": lambda i: t(i, "nonexistentterm123xyz"),
    "NEAR(a b, 0)": lambda i: match_near(i, ["a", "b"], 0),
    "NEAR(b a, 1)": lambda i: match_near(i, ["b", "a"], 1),
    "NEAR(a b)": lambda i: match_near(i, ["a", "b"]),
    "NEAR(a b c, 2)": lambda i: match_near(i, ["a", "b", "c"], 2),
    "NEAR(a b c, 5)": lambda i: match_near(i, ["a", "b", "c"], 5),
    'NEAR("a b" c, 3)': lambda i: match_near(i, ["a b", "c"], 3),
    'NEAR(c "a b", 0)': lambda i: match_near(i, ["c", "a b"], 0),
    'NEAR("a b" "c d" e, 6)': lambda i: match_near(i, ["a b", "c d", "e"], 6),
    'NEAR("?" a, 3)': lambda i: match_near(i, ["?", "a"], 3),
    'NEAR("?", 3)': lambda i: match_near(i, ["?"], 3),
    "title : NEAR(a b)": lambda i: match_near(i, ["a", "b"], columns=["title"]),
    "{title body} : NEAR(a b, 1)": lambda i: match_near(i, ["a", "b"], 1, columns=["title", "body"]),
    "- body : NEAR(a b)": lambda i: match_near(i, ["a", "b"], excluded=["body"]),
    '"a app" *': lambda i: match_prefix(i, "a app"),
    '"a b app" *': lambda i: match_prefix(i, "a b app"),
    'body : "a app" *': lambda i: match_prefix(i, "a app", columns=["body"]),
    "^app*": lambda i: match_prefix(i, "app", initial=True),
    '"?" *': lambda i: match_prefix(i, "?"),
}


@pytest.mark.parametrize("expression", CASES)
def test_match_equals_engine(corpus, expression):
    engine, _, index = corpus
    expected = dict(engine.execute("select rowid, rank from pages where pages match ?", (expression,)).fetchall())
    got = {r.doc_id: r["rank"] for r in ranked(CASES[expression](index)).collect()}
    assert set(got) == set(expected)
    assert all(abs(got[n] - expected[n]) < 1e-12 for n in got)


def test_stored_and_lazy_index_agree(corpus):
    _, documents, stored = corpus
    lazy = build_index(documents)
    columns = ["term", "doc_id", "dl", "tf", "places"]
    rows = lambda index: sorted(map(tuple, index.postings.select(*columns).collect()))
    assert rows(lazy) == rows(stored)
    assert corpus_stats(lazy).first() == corpus_stats(stored).first()


def test_dictionary_names_terms_frequencies_and_buckets(corpus):
    _, documents, stored = corpus
    expected = {row.term: row["df"] for row in document_frequencies(build_index(documents)).collect()}
    assert {row.term: row["df"] for row in document_frequencies(stored).collect()} == expected
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan(document_frequencies(stored)) and "places" not in plan(document_frequencies(stored))
    # A prefix opens the buckets of its terms only; one without terms opens none.
    wanted = {row.term_bucket for row in stored.terms.where("startswith(term, 'app')").collect()}
    found = {row.term_bucket for row in prefix_postings(stored, "app").select("term_bucket").distinct().collect()}
    assert found == wanted and len(wanted) < stored.buckets
    assert "term_bucket" in plan(prefix_postings(stored, "app")).split("PartitionFilters")[1][:200]
    assert prefix_postings(stored, "nothing").count() == 0


def test_search_cuts_after_ranking(corpus):
    engine, documents, index = corpus
    expected = [r[0] for r in engine.execute("select url from pages where pages match 'apple' order by rank, rowid limit 5")]
    hits = search(t(index, "apple"), documents, 5)
    assert hits.columns == SEARCH_HIT.names
    assert [r.url for r in hits.collect()] == expected
    assert search(t(index, "apple"), documents, 0).count() == 0
    assert search(t(index, "apple"), documents, -1).count() == t(index, "apple").count()
    assert search(t(index, "?!"), documents).count() == 0


@pytest.mark.parametrize("lazy", [False, True])
def test_batch_equals_single_searches(spark, corpus, lazy):
    engine, documents, index = corpus
    queries = [(1, "a b"), (2, "apple"), (3, "zebra zebra"), (4, "nope a"), (5, "crawler 2024 a"), (6, "?")]
    table = spark.createDataFrame(queries, "query_id bigint, query string")
    hits = search_batch(table, build_index(documents) if lazy else index, 7).collect()
    for number, words in queries:
        expected = []
        if words != "?":
            sql = "select rowid, rank from pages where pages match ? order by rank, rowid limit 7"
            expected = engine.execute(sql, (words,)).fetchall()
        got = sorted((h.position, h.doc_id, h["rank"]) for h in hits if h.query_id == number)
        assert [(n, row[0]) for n, row in enumerate(expected, 1)] == [row[:2] for row in got]
        assert all(abs(a[2] - b[1]) < 1e-12 for a, b in zip(got, expected))


def test_equal_documents_tie_by_insertion(spark):
    rows = [(f"u{n}", "t", "alpha beta gamma delta", "s", None, "e", "x", n) for n in range(1, 40)]
    rows += [(f"v{n}", "t", "other words here", "s", None, "e", "x", n) for n in range(40, 200)]
    index = build_index(spark.createDataFrame(rows, STORED_DOCUMENT))
    queries = spark.createDataFrame([(1, "delta gamma beta alpha")], "query_id bigint, query string")
    hits = search_batch(queries, index, 5).orderBy("position").collect()
    assert [h.doc_id for h in hits] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("stored", ["no", "anew", "in place"])
def test_index_follows_upserts(spark, corpus, tmp_path, stored):
    engine, documents, index = corpus
    changed = [(f"u{n}", "new title", "zebra a b fresh", "s", None, "crawler", "2025", 1000 + n) for n in (3, 7, 11, 500)]
    # One URL comes twice; the later row counts.
    rows = [(*row[:-1], 1000 + n) for n, row in enumerate([*changed[:1], *changed])]
    incoming = spark.createDataFrame(rows, STORED_DOCUMENT)

    fresh_engine = sqlite3.connect(":memory:")
    engine.backup(fresh_engine)
    for row in map(tuple, incoming.orderBy("ingest_seq").collect()):
        fresh_engine.execute("delete from pages where url = ?", (row[0],))
        fresh_engine.execute(
            "insert into pages(url, title, body, snippet, llm_summary, source_engine, crawled_timestamp, rowid)"
            " values (?, ?, ?, ?, ?, ?, ?, ?)",
            row,
        )

    removed, added = replaced_documents(documents, incoming), latest_per_url(incoming)
    after, path = updated_index(index, removed, added), f"{tmp_path}/after"
    if stored == "anew":
        store_index(after, path, buckets=8, range_rows=50)
        after = read_index(spark, path)
    elif stored == "in place":
        write_index(documents, path, buckets=8, range_rows=20)
        files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "after" / "postings").rglob("*.parquet")}
        before = files()
        for _ in range(2):  # a repeated update changes nothing
            update_index(spark, path, removed, added)
        changed = {name.split("seq_range=")[1].split("/")[0] for name, _ in before.items() ^ files().items()}
        assert changed == {"0", "50"}  # numbers 3, 7 and 11, and 1001 to 1004
        after = read_index(spark, path)
        assert corpus_stats(after).first() == corpus_stats(updated_index(index, removed, added)).first()
    for expression, matches in {
        "fresh": match_term(after, "fresh"),
        "zebra a": match_all(match_term(after, "zebra"), match_term(after, "a")),
        "app*": match_prefix(after, "app"),
        '"a b"': match_phrase(after, "a b"),
    }.items():
        expected = dict(fresh_engine.execute("select rowid, rank from pages where pages match ?", (expression,)))
        got = {r.doc_id: r["rank"] for r in ranked(matches).collect()}
        assert set(got) == set(expected)
        assert all(abs(got[n] - expected[n]) < 1e-12 for n in got)
    table = upsert(documents, incoming)
    assert table.count() == fresh_engine.execute("select count(*) from pages").fetchone()[0]


def test_near_and_prefix_with_phrases_on_dense_texts(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(["a", "ab", "b", "c", "d"]) for _ in range(rnd.randint(0, n)))
    rows = [(f"u{n}", text(4), text(12), "s", None, "e", "x", n) for n in range(1, 81)]
    engine = sqlite3.connect(":memory:")
    engine.execute(ENGINE_TABLE)
    engine.executemany("insert into pages values (?, ?, ?, ?, ?, ?, ?)", [row[:-1] for row in rows])
    index = build_index(spark.createDataFrame(rows, STORED_DOCUMENT))
    for expression, matches in {
        'NEAR("a b" c, 1)': match_near(index, ["a b", "c"], 1),
        'NEAR(c "a b" d, 2)': match_near(index, ["c", "a b", "d"], 2),
        'NEAR("b c" "c d", 0)': match_near(index, ["b c", "c d"], 0),
        'body : NEAR("a b" c, 1)': match_near(index, ["a b", "c"], 1, columns=["body"]),
        '"c a" *': match_prefix(index, "c a"),
    }.items():
        expected = dict(engine.execute("select rowid, rank from pages where pages match ?", (expression,)))
        got = {r.doc_id: r["rank"] for r in ranked(matches).collect()}
        assert expected and set(got) == set(expected)
        assert all(abs(got[n] - expected[n]) < 1e-12 for n in got)
