"""Document table on shared storage, in ranges of the insert sequence, and point reads.

An upsert rewrites the ranges of the documents it replaces and those of the new ones. Writing is
left to Spark's committed writes: a failed upsert leaves the rows in place, a repeated one changes nothing.
One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.operators.documents import latest_per_url
from trawlight.schemas import STORED_DOCUMENT
from trawlight.session import materialise
from trawlight.sources import ranges as r

_SCHEMA = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in STORED_DOCUMENT)


@dataclass(frozen=True)
class Change:
    """What an upsert did: ``removed (doc_id)`` left the table, ``added`` documents came in."""

    removed: DataFrame
    added: DataFrame


def create_if_absent(spark: SparkSession, path: str, range_rows: int = r.RANGE_ROWS) -> None:
    """Start an empty table unless one exists; a range holds ``range_rows`` insert sequences."""
    if r.read_layout(spark, path) is None:
        empty = spark.createDataFrame([], STORED_DOCUMENT).withColumn(r.RANGE, F.lit(0).cast("long"))
        r.write_ranges(empty, f"{path}/rows")
        r.write_layout(spark, path, range_rows=range_rows)


def read_ranged(spark: SparkSession, path: str) -> r.RangedTable:
    """The table with its ranges, for lookups that open only the folders they need."""
    layout = r.read_layout(spark, path)
    if layout is None:
        empty = spark.createDataFrame([], STORED_DOCUMENT).withColumn(r.RANGE, F.lit(None).cast("long"))
        return r.RangedTable(empty, r.RANGE_ROWS)
    return r.read_ranges(spark, f"{path}/rows", _SCHEMA, layout["range_rows"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents; an absent table reads as empty."""
    return read_ranged(spark, path).rows.drop(r.RANGE)


def upsert_documents(incoming: DataFrame, path: str, range_rows: int = r.RANGE_ROWS) -> Change:
    """Replace documents by URL and add new ones; every row needs an ``ingest_seq``.

    Of several rows of a URL the highest sequence counts. A row without a URL replaces only
    itself, so the same upsert may be repeated. Texts are read only in the ranges that change.
    """
    spark = incoming.sparkSession
    create_if_absent(spark, path, range_rows)
    table = read_ranged(spark, path)
    columns = [F.col(field.name).cast(field.dataType) for field in STORED_DOCUMENT]
    # Stored, so that what is generated on the way is the same in the table and in the index.
    added = materialise(latest_per_url(incoming.select(*columns)), "incoming-documents")
    keys = added.select(F.col("url").alias("_url"), F.col("ingest_seq").alias("_seq"))
    by_url = table.rows.join(keys.where("_url IS NOT NULL"), table.rows["url"] == F.col("_url"), "left_semi")
    itself = table.rows.where("url IS NULL").join(
        keys.where("_url IS NULL"), table.rows["ingest_seq"] == F.col("_seq"), "left_semi"
    )
    gone = by_url.select("ingest_seq", r.RANGE).unionByName(itself.select("ingest_seq", r.RANGE))
    gone = materialise(gone, "replaced-documents")
    touched = {row[0] for row in gone.select(r.RANGE).distinct().collect()}
    touched = sorted(touched | set(r.ranges_in(added, "ingest_seq", table.range_rows)))
    kept = table.of_ranges(touched).join(gone.select("ingest_seq"), "ingest_seq", "left_anti")
    new = added.withColumn(r.RANGE, r.range_of(F.col("ingest_seq"), table.range_rows))
    rows = materialise(kept.unionByName(new), "rewritten-documents")
    r.write_ranges(rows.repartition(r.RANGE), f"{path}/rows", touched, order=["ingest_seq"], filled=rows)
    return Change(gone.select(F.col("ingest_seq").alias("doc_id")), added)


def lookup(documents: DataFrame, url: str) -> DataFrame:
    """The row of one URL."""
    return documents.where(F.col("url") == url)
