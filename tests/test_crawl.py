"""Crawl order against a plain first-in-first-out queue, and the whole crawl job."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from trawlight.operators import crawl as C
from trawlight.operators.crawl import first_enqueued
from trawlight.operators.index import corpus_stats
from trawlight.operators.match import match_term
from trawlight.operators.search import search
from trawlight.plans.crawl_job import Collection, crawl_into, page_table, run_crawl, table_engine
from trawlight.sources.engines import engine_results

STAMP = "2024-01-01T00:00:00Z"


def queue_model(links, good, seeds, max_depth, max_pages, interval, found):
    queue, visited, out, since = deque((url, 0) for url in seeds), set(), [], 0
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        if url in visited:
            continue
        visited.add(url)
        out.append((url, depth, len(out) + 1, url in good))
        if url not in good:
            continue
        if depth < max_depth:
            for link in links[url]:
                if link not in visited and all(link != item[0] for item in queue):
                    queue.append((link, depth + 1))
        since += 1
        if found is not None and since >= interval:
            since = 0
            for link in found[url]:
                if link not in visited and all(link != item[0] for item in queue):
                    queue.append((link, 0))
    return out, {item[0] for item in queue} - visited


def run_case(spark, seed):
    rnd = random.Random(seed)
    names = [f"http://h/{n}" for n in range(rnd.randint(3, 25))]
    links = {u: [rnd.choice(names) for _ in range(rnd.randint(0, 4))] for u in names}
    links = {u: list(dict.fromkeys(v)) for u, v in links.items()}
    good = {u for u in names if rnd.random() < 0.8}
    seeds = [rnd.choice(names) for _ in range(rnd.randint(1, 4))]
    depth, pages, interval = rnd.randint(0, 3), rnd.choice([1, 3, 8, 100]), rnd.randint(1, 3)
    found = {u: [rnd.choice(names) for _ in range(2)] for u in names} if rnd.random() < 0.6 else None
    expected, queued = queue_model(links, good, seeds, depth, pages, interval, found)

    table = spark.createDataFrame([(u, links[u]) for u in sorted(good)], "url string, links array<string>")
    start = spark.createDataFrame([(u, 0, n) for n, u in enumerate(seeds, 1)], "url string, depth int, pos bigint")
    expand = None
    if found is not None:
        results = spark.createDataFrame([(u, i, v) for u in found for i, v in enumerate(found[u])], "src string, idx int, url string")
        expand = lambda triggers: triggers.select("pos", F.col("url").alias("src")).join(results, "src").select("pos", "idx", "url")
    result = C.crawl(table, start, depth, pages, expand, interval)
    rows = sorted(result.visited.collect(), key=lambda r: r.pos)
    assert [(r.url, r.depth, r.pos, r.ok) for r in rows] == expected
    assert {r.url for r in result.queued.collect()} == queued
    stats = C.crawl_stats(result).first()
    assert (stats.pages_visited, stats.pages_good, stats.urls_queued) == (
        len(expected),
        sum(row[3] for row in expected),
        len(queued),
    )


def test_order_equals_queue(spark):
    for seed in range(4):
        run_case(spark, seed)


def store(spark, pages):
    return spark.createDataFrame(pages, "url string, status int, html string")


def seeds(spark, *urls):
    return spark.createDataFrame([(u, 0, n) for n, u in enumerate(urls, 1)], "url string, depth int, pos bigint")


def echo_backend():
    # Nested, so that it travels to the workers by value.
    def make(model=None, **options):
        return lambda batch: [f"summary of {len(messages[-1]['content'])}" for messages in batch]

    return make


def test_budget_summary_and_one_search(spark):
    pages = store(spark, [("http://a.org/", 200, "<title>T</title><p>Hi</p>"), ("http://b.org/", 200, "<p>B</p>")])
    asked = []

    def engines(queries):
        asked.append(queries.collect())
        return [engine_results(queries.sparkSession.createDataFrame([], "query_id bigint, position bigint, title string, href string, body string"), "duckduckgo")]

    job = run_crawl(
        pages, seeds(spark, "http://a.org/", "http://b.org/"), STAMP, "fetchbot", max_depth=0, max_pages=1,
        make_backend=echo_backend(), engines=engines, metasearch_interval=1,
    )
    documents = job.documents.collect()
    assert [d.url for d in documents] == ["http://a.org/"]
    assert documents[0].llm_summary.startswith("summary of")
    assert len(asked) == 1 and [row.query_id for row in asked[0]] == [1]


def test_generation_off_and_failed_fetch(spark):
    pages = store(spark, [("http://a.org/", 200, "<title>Test Title</title><p>Text &amp; more</p>"), ("http://b.org/", 404, "x")])
    job = run_crawl(pages, seeds(spark, "http://b.org/", "http://a.org/"), STAMP, "fetchbot")
    document = job.documents.collect()
    assert [(d.url, d.title, d.body, d.llm_summary, d.source_engine, d.crawled_timestamp, d.ingest_seq) for d in document] == [
        ("http://a.org/", "Test Title", "Test Title Text & more", None, "crawler", STAMP, 2)
    ]
    assert job.crawl.visited.count() == 2


def test_search_results_enter_at_depth_zero(spark):
    html = '<title>{t}</title><a href="{h}">x</a>'
    pages = store(
        spark,
        [
            ("http://a.org/", 200, html.format(t="first", h="/one")),
            ("http://a.org/one", 200, html.format(t="one", h="/two")),
            ("http://s.org/", 200, html.format(t="found", h="/deep")),
            ("http://s.org/deep", 200, "<p>end</p>"),
        ],
    )
    results = spark.createDataFrame(
        [("first", 1, "t", "http://s.org/", "b"), ("first", 2, "t", "", "b"), ("first", 3, "t", "http://late.org/", "b")],
        "query string, position bigint, title string, href string, body string",
    )
    engine = table_engine(results)
    job = run_crawl(
        pages, seeds(spark, "http://a.org/"), STAMP, "fetchbot", max_depth=1,
        engines=lambda queries: [engine_results(engine(queries.withColumn("query_id", F.col("query_id"))), "duckduckgo")],
        metasearch_interval=1,
    )
    got = [(r.url, r.depth, r.wave) for r in job.crawl.visited.orderBy("pos").collect()]
    # The limit of two results holds before the empty URL is dropped.
    assert got == [
        ("http://a.org/", 0, 0), ("http://a.org/one", 1, 1), ("http://s.org/", 0, 1), ("http://s.org/deep", 1, 2),
    ]


def test_disallowed_pages_are_attempts_without_content(spark):
    pages = store(spark, [("http://a.org/private/x", 200, "<p>x</p>"), ("http://a.org/y", 200, "<p>y</p>")])
    robots = spark.createDataFrame(
        [("a.org", 1, 200, "User-agent: *\nDisallow: /private/")], "netloc string, seq bigint, status int, text string"
    )
    job = run_crawl(pages, seeds(spark, "http://a.org/private/x", "http://a.org/y", "mailto:me"), STAMP, "fetchbot", robots)
    assert [(r.url, r.ok) for r in job.crawl.visited.orderBy("pos").collect()] == [
        ("http://a.org/private/x", False), ("http://a.org/y", True), ("mailto:me", False),
    ]


def noisy_backend(folder):
    """Answers at random and writes down each prompt that it sees."""

    def make(model=None, **options):
        import uuid
        from pathlib import Path

        def answer(batch):
            for messages in batch:
                (Path(folder) / uuid.uuid4().hex).write_text(messages[-1]["content"], encoding="utf-8")
            return [uuid.uuid4().hex for _ in batch]

        return answer

    return make


def test_a_page_has_one_summary_and_a_search_one_wording(spark, tmp_path):
    prompts = tmp_path / "prompts"
    prompts.mkdir()
    pages = store(spark, [(f"http://a.org/{n}", 200, f"<title>T{n}</title><p>text {n}</p>") for n in range(6)])
    asked = []

    def engine(name):
        def results(queries):
            asked.append({row["query_id"]: row["query"] for row in queries.collect()})
            return engine_results(queries.select("query_id", F.lit(1).cast("bigint").alias("position"), F.lit("t").alias("title"), F.concat(F.lit(f"http://{name}.org/"), "query").alias("href"), F.lit("b").alias("body")), name)

        return results

    job = run_crawl(
        pages, seeds(spark, *(f"http://a.org/{n}" for n in range(6))), STAMP, "fetchbot", max_depth=0,
        make_backend=noisy_backend(str(prompts)), metasearch_interval=2,
        engines=lambda queries: [engine("google")(queries), engine("duckduckgo")(queries)],
    )
    first, second = ({d.url: d.llm_summary for d in job.documents.collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == 6
    assert asked[0] == asked[1]
    seen = [path.read_text(encoding="utf-8") for path in prompts.iterdir()]
    # Six pages and three searches; each search is worded from the summary that its page keeps.
    assert len(seen) == len(set(seen)) == 9
    assert sum(any(prompt.endswith(summary) for summary in first.values()) for prompt in seen) == 3


def test_two_crawls_into_one_collection(spark, tmp_path):
    html = "<title>{t}</title><p>{w}</p>"
    collection = Collection(str(tmp_path / "collection"))
    first = store(spark, [(f"http://a.org/{n}", 200, html.format(t=f"page {n}", w=f"old word{n}")) for n in range(5)])
    later = store(spark, [(f"http://a.org/{n}", 200, html.format(t=f"page {n}", w=f"new word{n}")) for n in range(3, 8)])
    crawl_into(collection, first, seeds(spark, *(f"http://a.org/{n}" for n in range(5))), STAMP, "fetchbot")
    job = crawl_into(collection, later, seeds(spark, *(f"http://a.org/{n}" for n in range(3, 8))), "later", "fetchbot")
    documents = collection.documents(spark).rows.collect()
    numbers = {d.url: d.ingest_seq for d in documents}
    assert len(documents) == len(numbers) == len(set(numbers.values())) == 8
    assert sorted(numbers.values()) == [1, 2, 3, 6, 7, 8, 9, 10]
    index = collection.index(spark)
    found = lambda word: sorted(hit.url for hit in search(match_term(index, word), collection.documents(spark)).collect())
    assert found("old") == [f"http://a.org/{n}" for n in range(3)]
    assert found("new") == [f"http://a.org/{n}" for n in range(3, 8)]
    before = corpus_stats(index).first()
    assert before.documents == 8
    collection.ingest(job.documents)  # repeated after a failure
    assert {d.url: d.ingest_seq for d in collection.documents(spark).rows.collect()} == numbers
    assert corpus_stats(collection.index(spark)).first() == before


def test_raw_pages_are_never_moved(spark):
    pages = store(spark, [("http://a.org/x", 200, "<p>x</p>"), ("http://a.org/y", 200, "<p>y</p>")])
    robots = spark.createDataFrame(
        [("a.org", 1, 200, "User-agent: *\nDisallow: /x")], "netloc string, seq bigint, status int, text string"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = page_table(pages, robots, "fetchbot")
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert [row.url for row in parsed.collect()] == ["http://a.org/y"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Below the exchange of the parsed pages stands the parsing, so nothing above it has the raw page.
    above = plan.split("Exchange hashpartitioning(url")[0]
    assert "Exchange" in plan and "html#" not in above


def test_queue_places_need_no_sort(spark):
    entries = spark.createDataFrame(
        [("u", 7, 1, 2, 0), ("u", 7, 0, 9, 3), ("u", 9, 0, 0, 1), ("v", (1 << 38) - 1, 1, (1 << 24) - 1, 2)],
        "url string, parent_pos bigint, kind int, idx int, depth int",
    )
    first = first_enqueued(entries)
    assert sorted(map(tuple, first.collect())) == [("u", 7, 0, 9, 3), ("v", (1 << 38) - 1, 1, (1 << 24) - 1, 2)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    with pytest.raises(Exception):
        first_enqueued(entries.withColumn("idx", F.lit(1 << 24))).collect()
