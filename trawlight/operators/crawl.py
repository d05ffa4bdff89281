"""Crawl order over a table of pages: breadth first, under a depth bound and a page budget.

A first-in-first-out queue works off whole waves: everything enqueued while one wave is processed
forms the next wave, ordered by the position of the enqueuing page, its own links before search
results, then by their order on the page. A URL is visited where it was first enqueued. Wave and
depth differ once search results enter at depth 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlight.session import materialise, number_and_count, scratch_path

# Defaults of the crawl parameters.
MAX_DEPTH = 3
MAX_PAGES = 100
METASEARCH_INTERVAL = 20
METASEARCH_RESULTS_PER_ENGINE = 2

OWN_LINK, SEARCH_RESULT = 0, 1
_INDEX_BITS, _PARENT_BITS = 24, 38

# Takes the triggering pages (url, pos), returns the URLs found for each: (pos, idx, url).
Expand = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Crawl:
    """``visited (url, depth, wave, pos, ok)`` and ``queued (url, depth, wave, pos)``."""

    visited: DataFrame
    queued: DataFrame


def first_enqueued(entries: DataFrame) -> DataFrame:
    """One row per URL: its first place in the queue, which also fixes its depth.

    A place is one number of parent, kind and index, so the smallest is found by hash aggregation:
    partial results reduce a URL that very many pages link to before the shuffle, and nothing is
    sorted. A page may have 2^24 links and a crawl 2^38 pages; more raise an error.
    """
    fits = (F.col("parent_pos") < 1 << _PARENT_BITS) & (F.col("idx") < 1 << _INDEX_BITS)
    packed = (
        F.shiftleft(F.col("parent_pos").cast("bigint"), _INDEX_BITS + 1)
        .bitwiseOR(F.shiftleft(F.col("kind").cast("bigint"), _INDEX_BITS))
        .bitwiseOR(F.col("idx").cast("bigint"))
    )
    place = F.when(fits, packed).otherwise(F.raise_error(F.lit("too many links or pages for one crawl")))
    first = entries.withColumn("_place", place).groupBy("url").agg(
        F.min("_place").alias("_place"), F.min_by("depth", "_place").alias("depth")
    )
    types = {name: entries.schema[name].dataType for name in ("parent_pos", "kind", "idx")}
    return first.select(
        "url",
        F.shiftright("_place", _INDEX_BITS + 1).cast(types["parent_pos"]).alias("parent_pos"),
        F.shiftright("_place", _INDEX_BITS).bitwiseAND(F.lit(1)).cast(types["kind"]).alias("kind"),
        F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).cast(types["idx"]).alias("idx"),
        "depth",
    )


def not_seen(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop URLs that were visited or queued before."""
    return entries.join(seen.select("url"), "url", "left_anti")


def own_link_entries(attempts: DataFrame, max_depth: int) -> DataFrame:
    """Queue entries from the links of pages above the depth bound."""
    return attempts.where(F.col("ok") & (F.col("depth") < max_depth)).select(
        F.col("pos").alias("parent_pos"),
        F.lit(OWN_LINK).alias("kind"),
        (F.col("depth") + 1).alias("depth"),
        F.posexplode("links").alias("idx", "url"),
    )


def search_entries(found: DataFrame) -> DataFrame:
    """Queue entries from search results: they start again at depth 0."""
    return found.select(
        F.col("pos").alias("parent_pos"),
        F.lit(SEARCH_RESULT).alias("kind"),
        F.lit(0).alias("depth"),
        F.col("idx").cast("int").alias("idx"),
        "url",
    )


def triggering_pages(attempts: DataFrame, interval: int, good_before: int = 0) -> tuple[DataFrame, int]:
    """Every ``interval``-th good page in crawl order, and the number of good pages so far.

    Pages without content do not count.
    """
    good, count = number_and_count(attempts.where("ok").select("url", "pos"), ["pos"], "n", good_before + 1)
    return good.where(F.col("n") % max(interval, 1) == 0).select("url", "pos", "n"), good_before + count


def crawl(
    page_links: DataFrame,
    seeds: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_pages: int = MAX_PAGES,
    expand: Expand | None = None,
    interval: int = METASEARCH_INTERVAL,
) -> Crawl:
    """Visit pages in queue order.

    ``page_links (url, links)`` holds the pages that can be fetched, one row each, with their
    resolved links in order; a visited URL without a row is a failed attempt, which still uses up
    budget. It is read once per wave and should be a stored table. Joining whole link arrays keeps both join keys unique. ``seeds (url, depth, pos)``
    may repeat URLs.

    The loop runs once per wave. Frontiers and good pages are stored as one folder per wave of two
    tables, so a wave reads its predecessors as one scan and no plan in the loop grows with their
    number. The frontier is joined from its files, so a small one is broadcast to the link table
    and only a large one shuffles it.
    """
    spark = page_links.sparkSession
    root = scratch_path(spark, "crawl")
    by_order = ["parent_pos", "kind", "idx"]
    entries = seeds.select(
        F.col("pos").alias("parent_pos"), F.lit(OWN_LINK).alias("kind"), F.lit(0).alias("idx"), "depth", "url"
    )
    seen = spark.createDataFrame([], "url string")
    next_pos, good_so_far, wave = 1, 0, 0
    frontiers = []
    while True:
        new = not_seen(first_enqueued(entries), seen)
        frontier, size = number_and_count(new, by_order, "pos", next_pos, f"{root}/frontier/wave={wave}")
        frontiers.append(frontier.select("url", "depth", F.lit(wave).alias("wave"), "pos"))
        if size == 0 or next_pos > max_pages:
            break
        taken = frontier.where(F.col("pos") <= max_pages).select("url", "depth", "pos")
        attempts = materialise(
            taken.join(page_links.select("url", "links"), "url"), "good", f"{root}/good/wave={wave}"
        ).withColumn("ok", F.lit(True))
        entries = own_link_entries(attempts, max_depth)
        if expand is not None:
            triggers, good_so_far = triggering_pages(attempts, interval, good_so_far)
            entries = entries.unionByName(search_entries(expand(triggers)))
        seen = spark.read.schema("url string").parquet(f"{root}/frontier")
        next_pos, wave = next_pos + size, wave + 1
    enqueued = reduce(DataFrame.unionByName, frontiers)
    if wave:
        good = spark.read.schema("url string").parquet(f"{root}/good").select("url", F.lit(True).alias("_good"))
        visited = enqueued.where(F.col("pos") <= max_pages).join(good, "url", "left")
        visited = visited.withColumn("ok", F.col("_good").isNotNull()).drop("_good")
    else:
        visited = enqueued.limit(0).withColumn("ok", F.lit(False))
    # Only the last wave worked on, and the one it enqueued, can reach beyond the budget.
    queued = reduce(DataFrame.unionByName, frontiers[-2:]).where(F.col("pos") > max_pages)
    return Crawl(visited, queued)


def crawl_stats(result: Crawl) -> DataFrame:
    """One row: pages visited, pages with content, URLs left in the queue."""
    rows = result.visited.select("ok", F.lit(1).alias("visited")).unionByName(
        result.queued.select(F.lit(False).alias("ok"), F.lit(0).alias("visited"))
    )
    return rows.agg(
        F.coalesce(F.sum("visited"), F.lit(0)).alias("pages_visited"),
        F.count_if("ok").alias("pages_good"),
        F.count_if(F.col("visited") == 0).alias("urls_queued"),
    )


def crawl_documents(pages: DataFrame, timestamp: str, first_sequence: int = 1) -> DataFrame:
    """Document rows of crawled pages ``(url, pos, title, text, snippet, llm_summary)``.

    Positions start at 1; ``first_sequence`` is the insert sequence of the first one.
    """
    return pages.select(
        "url",
        "title",
        F.col("text").alias("body"),
        "snippet",
        "llm_summary",
        F.lit("crawler").alias("source_engine"),
        F.lit(timestamp).alias("crawled_timestamp"),
        (F.col("pos") + (first_sequence - 1)).cast("bigint").alias("ingest_seq"),
    )
