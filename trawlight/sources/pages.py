"""Page store: fetching a URL is a lookup in a table of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_fetch(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """Attach the page content to each URL; a miss, an error status or no answer gives NULL.

    ``store`` has one row per URL: ``(url, status, html)``. It is first reduced to the URLs asked
    for: a semi join can broadcast a small frontier, which the outer join alone could not.
    """
    content = store.select("url", F.when(F.col("status") == 200, F.col("html")).alias("html"))
    asked = content.join(frontier.select("url").distinct(), "url", "left_semi")
    return frontier.join(asked, "url", "left")


def fetched_only(pages: DataFrame) -> DataFrame:
    """Drop URLs without content; an empty body counts as none."""
    return pages.where(F.col("html") != "")
