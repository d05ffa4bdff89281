"""Keeping the document table current: required keys, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlight.schemas import DOCUMENT_COLUMNS, REQUIRED_KEYS


def documents_from_json(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Typed documents from JSON text, without those that lack a required key.

    Presence counts, not the value: a key with a null value is present.
    """
    fields = F.from_json(column, "map<string,string>")
    present = rows.withColumn("_fields", fields)
    for key in REQUIRED_KEYS:
        present = present.where(F.map_contains_key("_fields", key))
    return present.select(*keep, *[F.try_element_at("_fields", F.lit(name)).alias(name) for name in DOCUMENT_COLUMNS])


def latest_per_url(documents: DataFrame) -> DataFrame:
    """The row with the highest ``ingest_seq`` of each URL; rows without a URL all stay.

    Rows without a URL go past the window, whatever their sequence. The row-number filter keeps at
    most one row per URL and task before the shuffle, so a URL with very many versions does not
    gather in one task.
    """
    newest_first = Window.partitionBy("url").orderBy(F.desc("ingest_seq"))
    named = documents.where(F.col("url").isNotNull()).withColumn("_version", F.row_number().over(newest_first))
    newest = named.where(F.col("_version") == 1).drop("_version")
    return newest.unionByName(documents.where(F.col("url").isNull()))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace documents by URL and append new ones; both sides carry ``ingest_seq``.

    Only the incoming rows are deduplicated, since the table already holds a URL once. The anti
    join compares keys only and broadcasts them by itself when they are few.
    """
    return delete_by_url(existing, incoming).unionByName(latest_per_url(incoming))


def upsert_newer(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert where the row with the higher ``ingest_seq`` stays, wherever it comes from.

    A missing sequence counts as the lowest; of equal ones the incoming row stays. Rows without a
    URL all stay. Only keys and sequences of the table are compared, so its texts are not shuffled
    when the incoming keys are few.
    """
    newest = latest_per_url(incoming)
    lowest = F.lit(-(1 << 63))
    new = newest.where(F.col("url").isNotNull()).select(
        F.col("url").alias("_url"), F.coalesce("ingest_seq", lowest).alias("_new")
    )
    newer = (existing["url"] == F.col("_url")) & (F.coalesce(existing["ingest_seq"], lowest) > F.col("_new"))
    replaced = (existing["url"] == F.col("_url")) & (F.coalesce(existing["ingest_seq"], lowest) <= F.col("_new"))
    stale = existing.join(new, newer, "left_semi").select("url")
    return existing.join(new, replaced, "left_anti").unionByName(newest.join(stale, "url", "left_anti"))


def delete_by_url(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the documents whose URL occurs in ``keys``; a NULL URL matches nothing."""
    return documents.join(keys.select("url").where(F.col("url").isNotNull()).distinct(), "url", "left_anti")


def replaced_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``doc_id`` of the stored documents that an upsert replaces, for the index."""
    keys = incoming.select("url").where(F.col("url").isNotNull()).distinct()
    return existing.join(keys, "url", "left_semi").select(F.col("ingest_seq").alias("doc_id"))


def next_sequence(existing: DataFrame) -> int:
    """The first unused insert sequence of a table."""
    return (existing.agg(F.max("ingest_seq")).first()[0] or 0) + 1
