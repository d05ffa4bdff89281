"""Headline queries, timed. Prints one JSON line.

The tables are read from $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
(default 8). Each query writes all its rows to the no-op sink. One small query first starts the
JVM and the Python workers; nothing else is warmed up, and building the index is timed as a query
of its own.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import all_queries
from checks.tables import stored_index
from trawlight.session import local_session

HEADLINE = [
    "page_parse",
    "link_edges",
    "robots_allowed",
    "ft_tokenize",
    "ft_postings",
    "ft_match_term",
    "ft_match_all",
    "ft_match_phrase",
    "ft_match_near",
    "ft_topk",
    "ft_search_batch",
    "meta_search_batch",
    "doc_upsert",
    "doc_stream_upsert",
    "llm_generate",
    "crawl_page_budget",
    "crawl_bfs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "trawlight-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["llm_generate"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("index_pages", lambda: stored_index(spark, sf_dir, "pages"))
    timed("index_documents", lambda: stored_index(spark, sf_dir, "documents"))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
