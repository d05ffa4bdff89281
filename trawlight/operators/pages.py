"""Pages to titles, texts and link edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlight.functions.html import html_hrefs, html_text, html_title
from trawlight.functions.text import snippet
from trawlight.functions.urls import absolute_only, base_parts, join_to, resolve_to

def page_parse(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """Replace ``html`` by ``title``, ``text``, ``links`` and ``snippet``.

    Links are resolved against the ``base`` column and kept once, in document order; without a
    base only absolute web addresses stay. Broken markup is read as a tolerant tokenizer does: an
    unclosed quote takes in text up to the next one. Everything runs inside the scan stage.
    """
    html = F.col("html")
    kept = [name for name in pages.columns if name != "html"]
    raw = pages.select(
        *kept,
        html_title(html).alias("title"),
        html_text(html).alias("text"),
        html_hrefs(html).alias("_hrefs"),
        *([base_parts(F.col(base)).alias("_base")] if base else []),
    )
    if base:
        targets = F.transform("_hrefs", lambda href: resolve_to(F.col("_base"), href))
    else:
        targets = absolute_only(F.col("_hrefs"))
    return raw.select(
        *kept, "title", "text", F.array_distinct(targets).alias("links"), snippet(F.col("text")).alias("snippet")
    )


def link_edges(parsed: DataFrame) -> DataFrame:
    """``(src_url, pos, dst_url)``: one row per distinct link of a page, joined as for a fetch."""
    based = parsed.select(F.col("url").alias("src_url"), base_parts(F.col("url")).alias("_base"), "links")
    return based.select("src_url", "_base", F.posexplode("links").alias("pos", "_link")).select(
        "src_url", "pos", join_to(F.col("_base"), F.col("_link")).alias("dst_url")
    )
