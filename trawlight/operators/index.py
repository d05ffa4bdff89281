"""Inverted index: one row per term and document, with the places where the term stands.

A place is one number, ``column * 2**32 + position``, so neighbouring tokens of a column differ by
one and tokens of different columns never do. Each document also has one row under the empty term,
which no text can contain; these rows give the corpus size and the document lengths, so one pass
over the texts produces everything that ranking needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.functions.text import tokens
from trawlight.schemas import SEARCHABLE
from trawlight.session import Scratch
from trawlight.sources.ranges import (
    RANGE, RANGE_ROWS, range_of, ranges_in, read_layout, read_ranges, write_layout, write_ranges,
)

COLUMN_STEP = 1 << 32
DOCUMENT_TERM = ""
# Ranges of up to so many documents are indexed by one task each.
TASK_DOCUMENTS = 1 << 14
POSTING_SCHEMA = "term string, doc_id bigint, dl int, tf bigint, places array<bigint>"
_POSTING_COLUMNS = ["term", "doc_id", "dl", "tf", "places"]
_COUNTED_COLUMNS = [RANGE, "term_bucket", "term", "tf", "dl"]
_STORED_POSTINGS = f"{POSTING_SCHEMA}, term_bucket int"
_STORED_TERMS = "term string, term_bucket int, df bigint, length bigint, most bigint, shortest int"


@dataclass(frozen=True)
class Index:
    """Postings; of a stored index also its number of term buckets, and its dictionary.

    The dictionary has a row per term and range of documents: in how many of them the term stands
    (``df``), how long these are together (``length``), how often it stands in one of them at most (``most``)
    and how long the shortest is (``shortest``).
    """

    postings: DataFrame
    buckets: int | None = None
    terms: DataFrame | None = None


def _tokenised(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id``, ``dl`` and one token array per searchable column present."""
    columns = [name for name in SEARCHABLE if name in documents.columns]
    split = documents.select(F.col(key).cast("bigint").alias("doc_id"), *[tokens(F.col(name)).alias(name) for name in columns])
    length = sum((F.size(name) for name in columns), F.lit(0))
    return split.select("doc_id", length.alias("dl"), *columns)


def _group_tokens(tokenised: DataFrame) -> DataFrame:
    """Postings of each document, grouped inside the scan task.

    Texts are tokenised in the JVM. Grouping the tokens of a row there would mean exploding them
    all and aggregating them back through object buffers that sort and shuffle every token; the
    Arrow batches need one integer sort and leave only finished postings to be shuffled.
    """
    names = tokenised.columns[2:]
    steps = [SEARCHABLE.index(name) * COLUMN_STEP for name in names]
    document_term, document_place, chunk_rows = DOCUMENT_TERM, -COLUMN_STEP, 512

    def group(rows: pa.RecordBatch) -> pa.RecordBatch:
        count = rows.num_rows
        numbers = np.arange(count)
        terms, owners, places = [pa.array([document_term] * count, pa.string())], [numbers], [np.full(count, document_place)]
        for name, step in zip(names, steps):
            lists = rows.column(name)
            lengths = np.diff(lists.offsets.to_numpy())
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            terms.append(lists.flatten().cast(pa.string()))
            owners.append(np.repeat(numbers, lengths))
            places.append(step + np.arange(len(starts)) - starts)
        encoded = pa.concat_arrays(terms).dictionary_encode()
        owner, place = np.concatenate(owners), np.concatenate(places)
        owned_term = owner * len(encoded.dictionary) + encoded.indices.to_numpy()
        # Stable: the places of a term stay in column and position order.
        order = np.argsort(owned_term, kind="stable")
        first = np.flatnonzero(np.diff(owned_term[order], prepend=-1))
        ends = np.append(first[1:], len(order))
        rows_of, heads = owner[order[first]], order[first]
        return pa.RecordBatch.from_arrays(
            [
                encoded.dictionary.take(encoded.indices.take(pa.array(heads))),
                rows.column("doc_id").take(pa.array(rows_of)),
                rows.column("dl").take(pa.array(rows_of)),
                pa.array(ends - first, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int64())),
            ],
            names=["term", "doc_id", "dl", "tf", "places"],
        )

    def group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                yield group(batch.slice(start, chunk_rows))

    return tokenised.mapInArrow(group_batches, POSTING_SCHEMA)


def build_index(documents: DataFrame, key: str = "ingest_seq") -> Index:
    """The index as a lazy view; it needs no shuffle."""
    return Index(_group_tokens(_tokenised(documents, key)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def updated_index(index: Index, removed: DataFrame, added: DataFrame, key: str = "ingest_seq") -> Index:
    """The index after documents were replaced: a lazy view over the old postings and the new texts.

    ``removed (doc_id)`` are documents that left the table, ``added`` those that came in. Only the
    new texts are tokenised.
    """
    gone = removed.select("doc_id").distinct()
    kept = index.postings.select(*_POSTING_COLUMNS).join(gone, "doc_id", "left_anti")
    return Index(kept.unionByName(build_index(added, key).postings))


def store_index(index: Index, path: str, buckets: int = 64, range_rows: int = RANGE_ROWS) -> None:
    """Store an index for pruned reads, at a new path.

    A posting's folder follows from the range of its document and the bucket of its term. A term that
    stands in every document is thus spread over as many tasks and files as there are ranges, a search opens
    one bucket of each, and a change of documents rewrites only their ranges.
    """
    _write(index.postings.select(*_POSTING_COLUMNS), path, buckets, range_rows)
    write_layout(index.postings.sparkSession, path, buckets=buckets, range_rows=range_rows)


def write_index(
    documents: DataFrame, path: str, buckets: int = 64, range_rows: int = RANGE_ROWS, key: str = "ingest_seq"
) -> None:
    """Index documents and store the result.

    The texts of a range that one task can index are brought together first, so that they are moved
    and not the postings, which are several times as large. Longer ranges have their postings moved.
    """
    if range_rows > TASK_DOCUMENTS:
        store_index(build_index(documents, key), path, buckets, range_rows)
        return
    columns = [name for name in SEARCHABLE if name in documents.columns]
    tasks = _tasks(documents.sparkSession)
    in_range = documents.select(key, *columns).repartition(tasks, range_of(F.col(key).cast("bigint"), range_rows))
    _write(build_index(in_range, key).postings, path, buckets, range_rows, together=True)
    write_layout(documents.sparkSession, path, buckets=buckets, range_rows=range_rows)


def update_index(spark: SparkSession, path: str, removed: DataFrame, added: DataFrame, key: str = "ingest_seq") -> None:
    """Bring a stored index up to date after documents were replaced.

    ``removed (doc_id)`` are documents that left the table, ``added`` those that came in. Only their
    ranges are read and rewritten; the files of all others stay. Repeating an update changes nothing,
    which also repairs one that was lost between the postings and the dictionary.
    """
    layout = read_layout(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no index at {path}")
    buckets, range_rows, scratch = layout["buckets"], layout["range_rows"], Scratch(spark)
    gone = removed.select(F.col("doc_id").cast("long")).unionByName(added.select(F.col(key).cast("long").alias("doc_id")))
    gone = scratch.store("replaced-ids", gone.distinct())
    touched = ranges_in(gone, "doc_id", range_rows)
    old = read_ranges(spark, f"{path}/postings", _STORED_POSTINGS, range_rows).of_ranges(touched)
    kept, new = old.join(gone, "doc_id", "left_anti"), _placed(build_index(added, key).postings, buckets, range_rows)
    # Stored, since what it is read from is overwritten; the dictionary then needs no look at the new folders.
    rows = scratch.store("rewritten-postings", kept.unionByName(new))
    moved = rows.repartition(_tasks(spark), RANGE, "term_bucket")
    write_ranges(moved, f"{path}/postings", touched, ("term_bucket", buckets), ["term", "doc_id"], rows)
    _write_terms(rows.where(F.col(RANGE).isNotNull()), path, range_rows, touched)
    scratch.drop()


def _tasks(spark: SparkSession) -> int:
    """Tasks that write folders: all partitions of a shuffle, since what Spark would put together by its size has many folders."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _placed(postings: DataFrame, buckets: int, range_rows: int) -> DataFrame:
    """Postings with the two numbers that name their folder."""
    placed = postings.withColumn("term_bucket", _bucket(F.col("term"), buckets))
    return placed.withColumn(RANGE, range_of(F.col("doc_id"), range_rows))


def _write(postings: DataFrame, path: str, buckets: int, range_rows: int, together: bool = False) -> None:
    """Write postings and then their dictionary.

    ``together`` says that all postings of a range are in one task already.
    """
    placed = _placed(postings, buckets, range_rows)
    if not together:
        placed = placed.repartition(RANGE, "term_bucket")
    write_ranges(placed, f"{path}/postings", by=("term_bucket", buckets), order=["term", "doc_id"])
    stored = read_ranges(postings.sparkSession, f"{path}/postings", _STORED_POSTINGS, range_rows)
    _write_terms(stored.rows, path, range_rows, None)


def _write_terms(placed: DataFrame, path: str, range_rows: int, touched: list[int] | None) -> None:
    """Write the dictionary of stored postings; ``touched`` are the ranges to replace, None all of them.

    It has one row per term and range; sorted, so that a range of terms is found by the statistics of the files.
    """
    if range_rows <= TASK_DOCUMENTS:
        # Few rows of a short range become one, so they are moved as they are, and once.
        terms = _dictionary(placed.select(*_COUNTED_COLUMNS).repartition(RANGE))
    else:
        terms = _dictionary(placed).repartition(RANGE)
    write_ranges(terms, f"{path}/terms", touched, order=["term"], filled=placed)


def _dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy(RANGE, "term", "term_bucket").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("dl").alias("length"),
        F.max("tf").alias("most"),
        F.min("dl").alias("shortest"),
    )


def ranged(index: Index) -> Index:
    """The same index with ranges and a dictionary; of a stored index as they are stored."""
    if index.terms is not None:
        return index
    postings = index.postings.withColumn("term_bucket", F.lit(0)).withColumn(RANGE, range_of(F.col("doc_id"), RANGE_ROWS))
    return Index(postings, None, _dictionary(postings))


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index; how it is laid out is read from beside it."""
    layout = read_layout(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no index at {path}")
    rows = layout["range_rows"]
    postings = read_ranges(spark, f"{path}/postings", _STORED_POSTINGS, rows).rows
    terms = read_ranges(spark, f"{path}/terms", _STORED_TERMS, rows).rows
    return Index(postings, layout["buckets"], terms)


def bucketed(terms: DataFrame, index: Index) -> tuple[DataFrame, list[str]]:
    """Terms with the keys to join them to postings; the bucket key prunes folders at run time."""
    if not index.buckets:
        return terms, ["term"]
    return terms.withColumn("term_bucket", _bucket(F.col("term"), index.buckets)), ["term_bucket", "term"]


def posting_list(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the given terms; a stored index opens only their buckets."""
    rows = index.postings.where(F.col("term").isin(terms))
    if index.buckets:
        wanted = F.array(*[_bucket(F.lit(term), index.buckets) for term in terms])
        rows = rows.where(F.array_contains(wanted, F.col("term_bucket")))
    return rows


def starting_with(column: Column, prefix: str) -> Column:
    """Terms with a prefix, as a range of the sorted terms where it has an upper end."""
    starts = (column != DOCUMENT_TERM) & column.startswith(prefix)
    last = ord(prefix[-1]) + 1
    # Surrogates are no characters, and nothing lies behind the last code point.
    if last == 0xD800 or last > 0x10FFFF:
        return starts & (column >= prefix)
    return starts & (column >= prefix) & (column < prefix[:-1] + chr(last))


def prefix_postings(index: Index, prefix: str) -> DataFrame:
    """Postings of all terms with a prefix; of a stored index only the buckets of these terms.

    The buckets are looked up in the dictionary; at most one number per bucket reaches the driver.
    """
    rows = index.postings.where(starting_with(F.col("term"), prefix))
    if index.terms is None:
        return rows
    held = index.terms.where(starting_with(F.col("term"), prefix)).select("term_bucket").distinct()
    return rows.where(F.col("term_bucket").isin([row[0] for row in held.collect()]))


def document_lengths(index: Index) -> DataFrame:
    """``(doc_id, dl)`` of every document, also of those without any token."""
    return posting_list(index, [DOCUMENT_TERM]).select("doc_id", "dl")


def corpus_stats(index: Index) -> DataFrame:
    """One row: the number of documents and their average length in tokens."""
    if index.terms is not None:
        whole = index.terms.where(F.col("term") == DOCUMENT_TERM)
        return whole.agg(
            F.coalesce(F.sum("df"), F.lit(0)).alias("documents"), (F.sum("length") / F.sum("df")).alias("average_length")
        )
    return document_lengths(index).agg(F.count("*").alias("documents"), F.avg("dl").alias("average_length"))


def document_frequencies(index: Index) -> DataFrame:
    """``(term, df)``: in how many documents each term stands; a stored index reads no postings for it."""
    if index.terms is not None:
        return index.terms.where(F.col("term") != DOCUMENT_TERM).groupBy("term").agg(F.sum("df").alias("df"))
    return index.postings.where(F.col("term") != DOCUMENT_TERM).groupBy("term").agg(F.count("*").alias("df"))


def document_frequency(index: Index, term: str) -> DataFrame | None:
    """One row with the ``df`` of a term from the dictionary; None for an index without one."""
    if index.terms is None:
        return None
    return index.terms.where(F.col("term") == term).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
