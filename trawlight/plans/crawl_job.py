"""The whole crawl: permission, fetch, parse, order, expansion, documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlight.functions.urls import base_parts, is_fetchable, join_to
from trawlight.operators import crawl as order
from trawlight.operators.generate import Backend, with_summary
from trawlight.operators.metasearch import Engines, rewritten_search
from trawlight.operators.pages import page_parse
from trawlight.operators.documents import next_sequence
from trawlight.operators.index import Index, build_index, read_index, store_index, update_index
from trawlight.operators.robots import disallowed_urls, host_policies, robots_hosts, robots_rules
from trawlight.schemas import STORED_DOCUMENT
from trawlight.session import materialise, scratch_path
from trawlight.sources.documents import Change, create_if_absent, read_documents, read_ranged, upsert_documents
from trawlight.sources.ranges import RANGE_ROWS, RangedTable, read_layout


@dataclass(frozen=True)
class CrawlJob:
    crawl: order.Crawl
    documents: DataFrame


def table_engine(results: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An engine that answers from a table of results keyed by query text."""
    return lambda queries: queries.join(results, "query").drop("query")


def metasearch_query(title: Column, summary: Column, first_seed: str, use_summary: bool = True) -> Column:
    """What to search for: the summary if wanted, else the title, else the first seed."""
    chosen = F.when(F.lit(use_summary), F.nullif(summary, F.lit("")))
    return F.coalesce(chosen, F.nullif(title, F.lit("")), F.lit(first_seed))


def page_table(store: DataFrame, robots: DataFrame | None, agent: str) -> DataFrame:
    """Parsed pages that a crawler may fetch and that have content, one row per URL.

    Permission is decided on URLs alone, and the disallowed ones are taken out of the parsed pages, so raw
    pages are never moved: they are read, parsed and dropped in one stage.
    """
    fetchable = store.where(is_fetchable(F.col("url")) & (F.col("status") == 200) & (F.col("html") != ""))
    parsed = page_parse(fetchable.select("url", "html"))
    if robots is None:
        return parsed
    policies = host_policies(robots_rules(robots_hosts(robots)), agent)
    denied = disallowed_urls(fetchable.select("url"), policies)
    return parsed.join(denied, "url", "left_anti")


def with_queue_links(parsed: DataFrame) -> DataFrame:
    """Parsed pages with every link joined to its page once more, as the queue holds it."""
    based = parsed.withColumn("_base", base_parts(F.col("url")))
    return based.withColumn("links", F.transform("links", lambda link: join_to(F.col("_base"), link))).drop("_base")


def run_crawl(
    store: DataFrame,
    seeds: DataFrame,
    timestamp: str,
    agent: str,
    robots: DataFrame | None = None,
    max_depth: int = order.MAX_DEPTH,
    max_pages: int = order.MAX_PAGES,
    make_backend: Callable[..., Backend] | None = None,
    summaries: bool = True,
    engines: Engines | None = None,
    metasearch_interval: int = order.METASEARCH_INTERVAL,
    results_per_engine: int = order.METASEARCH_RESULTS_PER_ENGINE,
    query_from_summary: bool = True,
    first_sequence: int = 1,
) -> CrawlJob:
    """Crawl a page store ``(url, status, html)`` from ``seeds (url, depth, pos)``.

    Pages are read and parsed once and stored as a narrow table; the waves then only touch URLs
    and links, and the documents are joined from the parsed table at the end. A page has one summary: what
    a search is made from is stored and becomes part of its document. Documents are numbered
    from ``first_sequence`` in crawl order; a page without content leaves its number out.
    """
    parsed = materialise(with_queue_links(page_table(store, robots, agent)), "parsed")
    backend = make_backend if summaries else None
    first_seed = seeds.agg(F.min_by("url", "pos")).first()[0]
    summaries_path, summarised = scratch_path(store.sparkSession, "summaries"), []

    def expand(triggers: DataFrame) -> DataFrame:
        pages = triggers.select("url", "pos").join(parsed.select("url", "title", "text"), "url")
        if query_from_summary and backend is not None:
            path = f"{summaries_path}/wave={len(summarised)}"
            summaries = with_summary(pages, backend).select("url", "pos", "title", "llm_summary")
            pages = materialise(summaries, "summaries", path)
            summarised.append(path)
        else:
            pages = with_summary(pages, None)
        queries = pages.select(
            F.col("pos").alias("query_id"),
            metasearch_query(F.col("title"), F.col("llm_summary"), first_seed, query_from_summary).alias("query"),
        )
        merged = rewritten_search(queries, engines, make_backend, results_per_engine)
        in_order = Window.partitionBy("query_id").orderBy("engine_seq", "position")
        return merged.select(F.col("query_id").alias("pos"), F.row_number().over(in_order).alias("idx"), "url")

    result = order.crawl(
        parsed.select("url", "links"),
        seeds,
        max_depth,
        max_pages,
        expand if engines is not None else None,
        metasearch_interval,
    )
    # Stored, so that a small crawl is broadcast to the parsed pages instead of shuffling them.
    good = materialise(result.visited.where("ok").select("url", "pos"), "visited")
    pages = good.join(parsed.select("url", "title", "text", "snippet"), "url")
    if summarised:
        known = store.sparkSession.read.schema("url string, llm_summary string").parquet(summaries_path).drop("wave")
        rest = with_summary(pages.join(known.select("url"), "url", "left_anti"), backend)
        pages = rest.unionByName(pages.join(known, "url"))
    else:
        pages = with_summary(pages, backend)
    return CrawlJob(result, order.crawl_documents(pages, timestamp, first_sequence))


@dataclass(frozen=True)
class Collection:
    """A document table and its index, below one path."""

    path: str

    @property
    def documents_path(self) -> str:
        return f"{self.path}/documents"

    @property
    def index_path(self) -> str:
        return f"{self.path}/index"

    def documents(self, spark: SparkSession) -> RangedTable:
        return read_ranged(spark, self.documents_path)

    def index(self, spark: SparkSession) -> Index:
        return read_index(spark, self.index_path)

    def create_if_absent(self, spark: SparkSession, buckets: int = 64, range_rows: int = RANGE_ROWS) -> None:
        create_if_absent(spark, self.documents_path, range_rows)
        if read_layout(spark, self.index_path) is None:
            empty = spark.createDataFrame([], STORED_DOCUMENT)
            store_index(build_index(empty), self.index_path, buckets, range_rows)

    def ingest(self, documents: DataFrame) -> Change:
        """Upsert documents and bring the index up to date; repeating it after a failure changes nothing more."""
        change = upsert_documents(documents, self.documents_path)
        update_index(documents.sparkSession, self.index_path, change.removed, change.added)
        return change


def crawl_into(collection: Collection, store: DataFrame, seeds: DataFrame, timestamp: str, agent: str, **options) -> CrawlJob:
    """Crawl, then put the documents into a collection and its index.

    Insert sequences go on where the collection ends, so a page that is crawled again replaces its
    document, and numbers stay unique over any number of crawls. ``options`` are those of ``run_crawl``.
    """
    spark = store.sparkSession
    collection.create_if_absent(spark)
    first = next_sequence(read_documents(spark, collection.documents_path))
    job = run_crawl(store, seeds, timestamp, agent, first_sequence=first, **options)
    change = collection.ingest(job.documents)
    return CrawlJob(job.crawl, change.added)
