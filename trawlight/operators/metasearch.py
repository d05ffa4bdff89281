"""Merging the result lists of several engines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlight.operators.generate import Backend, rewrite_queries
from trawlight.session import materialise
from trawlight.sources.engines import ENGINE_ORDER

# Takes queries (query_id, query), returns one result table per engine.
Engines = Callable[[DataFrame], list[DataFrame]]

DEFAULT_RESULTS_PER_ENGINE = 10


def select_engines(results: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Results of the chosen engines; all known ones by default. Unknown names have no effect."""
    chosen = [name for name in ENGINE_ORDER if engines is None or name in engines]
    return results.where(F.col("source_engine").isin(chosen))


def limit_per_engine(results: DataFrame, limit: int = DEFAULT_RESULTS_PER_ENGINE) -> DataFrame:
    """The first results of each engine for each query; tasks cut their share before the shuffle."""
    in_order = Window.partitionBy("query_id", "source_engine").orderBy("position")
    numbered = results.withColumn("_place", F.row_number().over(in_order))
    return numbered.where(F.col("_place") <= limit).drop("_place")


def union_engines(*lists: DataFrame) -> DataFrame:
    """One table of results with ``engine_seq``, the fixed rank of the engine."""
    together = reduce(DataFrame.unionByName, lists)
    order = F.array(*[F.lit(name) for name in ENGINE_ORDER])
    return together.withColumn("engine_seq", F.array_position(order, F.col("source_engine")).cast("int") - 1)


def with_url(results: DataFrame) -> DataFrame:
    """Drop results that have no URL."""
    return results.where(F.col("url") != "")


def first_per_url(results: DataFrame) -> DataFrame:
    """Each URL of a query once: the first engine, then the first position, wins."""
    in_order = Window.partitionBy("query_id", "url").orderBy("engine_seq", "position")
    return results.withColumn("_turn", F.row_number().over(in_order)).where(F.col("_turn") == 1).drop("_turn")


def result_counts(limited: DataFrame) -> DataFrame:
    """Results of each engine before merging, and the number of distinct URLs per query."""
    per_engine = [
        F.count(F.when(F.col("source_engine") == name, True)).alias(f"{name}_results") for name in ENGINE_ORDER
    ]
    named = F.when(F.col("url") != "", F.col("url"))
    once = limited.groupBy("query_id", named.alias("url")).agg(*per_engine)
    totals = [F.sum(f"{name}_results").alias(f"{name}_results") for name in ENGINE_ORDER]
    return once.groupBy("query_id").agg(*totals, F.count("url").alias("unique_results"))


def merge_results(
    lists: list[DataFrame], limit: int = DEFAULT_RESULTS_PER_ENGINE, engines: list[str] | None = None
) -> DataFrame:
    """Merged results of every query.

    The limit comes before the URL filter and the merge, so an engine may contribute fewer rows.
    """
    chosen = select_engines(union_engines(*lists), engines)
    return first_per_url(with_url(limit_per_engine(chosen, limit)))


def rewritten_search(
    queries: DataFrame,
    engines: Engines,
    make_backend: Callable[..., Backend] | None = None,
    limit: int = DEFAULT_RESULTS_PER_ENGINE,
    chosen: list[str] | None = None,
    model: str | None = None,
) -> DataFrame:
    """Rewrite each query of ``(query_id, query)``, ask the engines and merge what they find.

    The rewritten queries are stored, so that a backend answers once and every engine is asked the
    same. Without a backend or an answer the query stays as it is.
    """
    asked = rewrite_queries(queries, make_backend, model).select("query_id", F.col("enhanced").alias("query"))
    return merge_results(engines(materialise(asked, "asked")), limit, chosen)
