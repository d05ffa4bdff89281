"""Shared pieces of the operators: inputs, words, checksums and Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower-cases A-Z and nothing else; applies to UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a document table, whatever else it has; a null text is empty."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))


def words_of(text: str) -> list[bytes]:
    """UTF-8 words: runs without the characters U+0020 and U+0009 to U+000D (what ``bytes.split`` splits at)."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def crc_fold(column: Column, folds: int) -> Column:
    """``crc32`` of a value written as text, modulo ``folds``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def crc_remainder(value: int | None, folds: int) -> int | None:
    """``crc_fold`` of one value, in a task."""
    return None if value is None else zlib.crc32(str(value).encode()) % folds


def columns_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Python lists of the named columns, batch by batch; empty batches are left out."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]


def release_memory() -> None:
    """Give the unused Arrow memory of a worker back at the end of a task, as the worker goes on to other stages."""
    pa.default_memory_pool().release_unused()


def batches_of(schema: pa.Schema, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[field.name], type=field.type) for field in schema], schema=schema
    )
