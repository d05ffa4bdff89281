"""Search-engine results: raw rows of one engine brought to the common layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Engines are merged in this order, whatever order they are asked for.
ENGINE_ORDER = ["google", "duckduckgo"]


def engine_results(raw: DataFrame, engine: str) -> DataFrame:
    """``(query_id, position, title, href, body)`` rows as results tagged with their engine.

    Missing fields become empty text.
    """
    return raw.select(
        "query_id",
        "position",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("href", F.lit("")).alias("url"),
        F.coalesce("body", F.lit("")).alias("snippet"),
        F.lit(engine).alias("source_engine"),
    )
