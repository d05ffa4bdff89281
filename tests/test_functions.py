"""Text, URL and HTML columns against the standard library and the fixtures."""

import random
import sqlite3
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from trawlight.functions import html, text, urls
from reference_parser import read_page
from trawlight.operators.pages import link_edges, page_parse

BASES = [
    "https://example.com/a/b?q=1#f", "http://x.org", "http://x.org/", "https://h:80/a/b/c/", "http://x.org/a;p/b",
    "http://x.org?q=1",
]
HREFS = [
    "/r", "p.html", "../x", "?z=1", "#s", "//o.com/x", "mailto:a@b", "tel:1", "javascript:void(0)", "data:x,y",
    "HTTP://U.com/X", " /lead", "a\tb\nc", "http:foo", "https:bar", ".", "..", "./", "../", "a/./b/../c", "/a/../../b",
    "/a//b", "a//b/", "x#", "x?", "?", "#", "http://h.com?", "///x", "//", "a;b", ";x", "/.", "/..", "é ü", "a:b", "1:2",
    ":x", "g?y/../x", "g#s/../x", "..a", "...", "a/b/..",
]


def test_url_join_equals_standard_library(spark):
    rnd = random.Random(1)
    pieces = ["a", "b", "..", ".", "", "c.html", "?", "?q", "#", "#f", "/", "//", "http:", "x:y"]
    made = {"".join(rnd.choice(pieces) + rnd.choice(["/", ""]) for _ in range(rnd.randint(1, 6))) for _ in range(400)}
    rows = [(base, href) for base in BASES for href in sorted(made | set(HREFS))]
    table = spark.createDataFrame(rows, "base string, href string")
    joined = table.select("base", "href", urls.url_join(F.col("base"), F.col("href")).alias("got"))
    wrong = [(r.base, r.href, r.got) for r in joined.collect() if r.got != urljoin(r.base, r.href)]
    assert wrong == []


def test_absolute_links_stay_verbatim(spark):
    rows = [("https://h/a", "https://h/b#"), ("https://h/a", "HTTPS://h/b#"), ("https://h/a", "/b#")]
    table = spark.createDataFrame(rows, "base string, href string")
    got = [r[0] for r in table.select(urls.url_resolve(F.col("base"), F.col("href"))).collect()]
    assert got == ["https://h/b#", "https://h/b", "https://h/b"]


def test_url_parts(spark):
    rows = [("HTTP://User@Host:80/p?q#f",), ("mailto:x@y",), ("/p",), ("http:///x",), ("ftp://h",)]
    url = F.col("url")
    table = spark.createDataFrame(rows, "url string")
    got = [tuple(r) for r in table.select(urls.scheme(url), urls.netloc(url), urls.is_fetchable(url)).collect()]
    assert got == [
        ("http", "User@Host:80", True), ("mailto", "", False), ("", "", False), ("http", "", False), ("ftp", "h", True),
    ]


def test_tokens_equal_full_text_engine(spark):
    """Letter by letter, for all characters that the engine's Unicode version knows."""
    codes = [c for c in range(0x20, 0x3000) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    engine = sqlite3.connect(":memory:")
    engine.execute('create virtual table t using fts5(a, tokenize="unicode61 remove_diacritics 2")')
    engine.execute("create virtual table v using fts5vocab(t, instance)")
    engine.executemany("insert into t(rowid, a) values (?, ?)", [(c, f"q{chr(c)}w") for c in codes])
    expected = {}
    for term, row in engine.execute("select term, doc from v order by doc, offset"):
        expected.setdefault(row, []).append(term)
    table = spark.createDataFrame([(c, f"q{chr(c)}w") for c in codes], "code int, a string")
    got = {r.code: r.t for r in table.select("code", text.tokens(F.col("a")).alias("t")).collect()}
    wrong = {c for c in codes if got[c] != expected[c] and unicodedata.category(chr(c))[0] in "LNZPS"}
    # Letters that got a lower-case partner, or another category, after the engine's Unicode version.
    newer = set(range(0x13A0, 0x13F6)) | set(range(0x10A0, 0x10C6)) | set(range(0x10D0, 0x1100))
    assert {hex(c) for c in wrong - newer if unicodedata.category(chr(c))[0] in "LN"} == set()
    assert all(text.query_tokens(f"q{chr(c)}w") == got[c] for c in codes if c < 0x250)


def test_snippet_and_strip(spark):
    table = spark.createDataFrame([("x" * 200,), ("y" * 201,), ("　 a \t",)], "t string")
    got = [tuple(r) for r in table.select(text.snippet(F.col("t")), text.strip(F.col("t"))).collect()]
    assert got[0][0] == "x" * 200 and got[1][0] == "y" * 200 + "..."
    assert got[2][1] == "a"


HARBOUR = """<!doctype html><html lang=en><head><title>Harbour log</title><meta name=x content="a>b"></head>
<body><h1>Ships</h1><ul><li><a href="https://port.example.net/berths/7">berth seven</a><li><a href="/tides">tides</a>
<li><a class='ext' href='http://weather.example.org/now'>weather</a><li><a href=crew/list.html>crew</a></ul></body></html>"""
PAGES = [
    # (html, base, title, text, links)
    (
        HARBOUR, "https://port.example.net/log/", "Harbour log", "Harbour log Ships berth seven tides weather crew",
        ["https://port.example.net/berths/7", "https://port.example.net/tides", "http://weather.example.org/now",
         "https://port.example.net/log/crew/list.html"],
    ),
    ("<div>Nothing<br>leads on</div> <em>from here</em>", "http://quiet.example", "", "Nothing leads on from here", []),
    ('<a href="../up">up</a><a href="//cdn.example/x.js">cdn</a>', "http://deep.example/a/b/c", "", "up cdn",
     ["http://deep.example/a/up", "http://cdn.example/x.js"]),
    ("", "http://quiet.example", "", "", []),
    # Different spellings of one target are one link, the first place counts.
    (
        '<a href="./n">i</a><a href="http://d.example/m">ii</a><a href="n">iii</a><a href="/n">iv</a><a href="/m">v</a>',
        "http://d.example/", "", "i ii iii iv v", ["http://d.example/n", "http://d.example/m"],
    ),
    ('<a href="map?lat=1&amp;lon=2#north">N</a><a href="#top">T</a>', "http://m.example/w?z=3", "", "N T",
     ["http://m.example/map?lat=1&lon=2#north", "http://m.example/w?z=3#top"]),
    ("<p>and&amp To</p>", "http://b.com", "", "and& To", []),
    (
        '<!-- <a href="/no">no</a> --><script>var a = "<p>no</p>";</script><style>p{}</style><TITLE> T &lt;1&gt; </TITLE>'
        '<a title="a>b" href="/x">x&#65;&#x42;</a><a href="">e</a><a>n</a>',
        "http://b.com", "T <1>", "T <1> xAB e n", ["http://b.com/x"],
    ),
]


def test_page_fixtures(spark):
    rows = [(n, base, page) for n, (page, base, *_) in enumerate(PAGES)]
    got = {r.n: r for r in page_parse(spark.createDataFrame(rows, "n int, url string, html string")).collect()}
    for n, (page, base, title, words, links) in enumerate(PAGES):
        assert (got[n].title, got[n].text, got[n].links) == (title, words, links) == read_page(page, base)


def test_without_base_only_absolute_links(spark):
    page = '<a href="near">n</a><a href="ftp://f.example/">f</a><a href="http://far.example/?k#v">w</a><a href="/root">r</a>'
    table = spark.createDataFrame([(page,)], "html string")
    assert page_parse(table, base=None).first().links == read_page(page, None)[2] == ["http://far.example/?k#v"]


TORN = [
    '<title>Torn sheet</title><p>legible part</p><a href="/whole">whole</a>\n<a href="/torn>gap <b title=">rest</b><a href>bare</a>',
    "<p>a</p><a href='/x class=y>z</a> it's over",
    '<p>a<a href="/x>never closed <b>text</b>',
    '<a href="/a"b="c">t</a>',
    "<a href=/q\">u</a><p",
    "x < y <b>z</b> <a href = /s >s</a>",
]


def test_torn_pages_equal_the_standard_library(spark):
    rows = [(n, "http://t.example/", page) for n, page in enumerate(TORN)]
    got = {r.n: r for r in page_parse(spark.createDataFrame(rows, "n int, url string, html string")).collect()}
    for n, base, page in rows:
        assert (got[n].title, got[n].text, got[n].links) == read_page(page, base), page
    assert got[0].links == ["http://t.example/whole", "http://t.example/torn>gap <b title="]


def test_edges_follow_links(spark):
    table = spark.createDataFrame([("http://h/a", '<a href="/b">b</a><a href="c">c</a>')], "url string, html string")
    got = [tuple(r) for r in link_edges(page_parse(table)).orderBy("pos").collect()]
    assert got == [("http://h/a", 0, "http://h/b"), ("http://h/a", 1, "http://h/c")]


def test_unknown_references_stay(spark):
    table = spark.createDataFrame([("&nope; &copy;1 &euro;&#128512; &#0; a&b",)], "t string")
    assert table.select(html.decode_references(F.col("t"))).first()[0] == "&nope; ©1 €😀 � a&b"
