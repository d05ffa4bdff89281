"""Robots rules against the standard library on random texts, and the fetch fixtures."""

import random
import urllib.robotparser

from trawlight.operators import robots as r
from trawlight.sources.pages import fetched_only, page_fetch

AGENT = "Fetchbot/0.1"
PATHS = ["/", "/private", "/private/", "", "*", "/a%20b", "/a b", "/pri", "/private/x", "/x?y=1", "/é", "/%C3%A9", "/a+b", "/~u", "/a#b", "/p;q", "/$", "x", "/%zz"]
TARGETS = ["/", "", "/private/x", "/private", "/a%20b/c", "/a b", "/x?y=1", "/é", "/%C3%A9", "/a+b", "/~u/", "/a#b", "/p;q", "/$1", "/private/page.html", "/pri%76ate/z", "/%zz/1"]


def random_line(rnd):
    chance = rnd.random()
    for limit, line in ((0.13, ""), (0.16, "   "), (0.2, "# comment"), (0.22, "no colon")):
        if chance < limit:
            return line
    key = rnd.choice(["User-agent", "user-agent", "DISALLOW", "Disallow", "allow", " Allow ", "Crawl-delay", "Request-rate", "Sitemap", "junk"])
    if key.lower() == "user-agent":
        value = rnd.choice(["*", "fetchbot", "FetchBot/0.1", "fetch", "otherbot", "Fetchbot", "bot", "*"])
    elif key == "Crawl-delay":
        value = rnd.choice(["5", "x"])
    elif key == "Request-rate":
        value = rnd.choice(["1/5", "1"])
    else:
        value = rnd.choice(PATHS)
    return f"{key}: {value}{rnd.choice(['', '', ' # c'])}"


def decide(spark, texts, targets):
    hosts = spark.createDataFrame([(f"h{n}.org", text) for n, text in enumerate(texts)], "netloc string, text string")
    urls = spark.createDataFrame([(f"http://h{n}.org{path}",) for n in range(len(texts)) for path in targets], "url string")
    policies = r.host_policies(r.robots_rules(hosts), AGENT)
    return {row.url: row.allowed for row in r.robots_allowed(urls, policies).collect()}


def test_decisions_equal_standard_library(spark):
    rnd = random.Random(5)
    texts = ["\n".join(random_line(rnd) for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    got = decide(spark, texts, TARGETS)
    for n, text in enumerate(texts):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        for path in TARGETS:
            url = f"http://h{n}.org{path}"
            assert got[url] == parser.can_fetch(AGENT, url), (url, text)


def test_first_match_and_agent_rules(spark):
    texts = [
        "User-agent: *\nAllow: /\nDisallow: /private",
        "User-agent: *\nDisallow: /pri\nAllow: /private/x",
        "User-agent: Fetchbot/0.1\nDisallow: /",
        "User-agent: Fetchbot\nDisallow: /",
        "User-agent: *\nDisallow: *",
    ]
    got = decide(spark, texts, ["/private/x"])
    assert list(got[f"http://h{n}.org/private/x"] for n in range(5)) == [True, False, True, False, True]


def test_first_good_answer_counts_and_errors_allow(spark):
    answers = spark.createDataFrame(
        [
            ("a.org", 3, 200, "User-agent: *\nDisallow: /"), ("a.org", 2, 200, "User-agent: *\nAllow: /"),
            ("a.org", 1, 500, "User-agent: *\nDisallow: /"), ("b.org", 1, 404, "User-agent: *\nDisallow: /"),
            ("c.org", 1, None, None),
        ],
        "netloc string, seq bigint, status int, text string",
    )
    hosts = r.robots_hosts(answers)
    assert [(h.netloc, h.text) for h in hosts.collect()] == [("a.org", "User-agent: *\nAllow: /")]
    urls = spark.createDataFrame([("http://a.org/x",), ("https://b.org/x",), ("http://c.org/x",)], "url string")
    assert r.allowed_only(urls, r.host_policies(r.robots_rules(hosts), AGENT)).count() == 3


def test_fetch_outcomes(spark):
    pages = spark.createDataFrame(
        [("http://h/ok", 200, "<p>"), ("http://h/404", 404, "no"), ("http://h/timeout", None, None), ("http://h/empty", 200, "")],
        "url string, status int, html string",
    )
    wanted = spark.createDataFrame([(f"http://h/{n}",) for n in ("ok", "404", "timeout", "empty", "missing")], "url string")
    fetched = page_fetch(wanted, pages)
    assert {row.url: row.html for row in fetched.collect()} == {
        "http://h/ok": "<p>", "http://h/404": None, "http://h/timeout": None, "http://h/empty": "", "http://h/missing": None,
    }
    assert [row.url for row in fetched_only(fetched).collect()] == ["http://h/ok"]
