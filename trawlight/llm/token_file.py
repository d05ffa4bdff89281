"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A token file is a folder. ``dictionary`` holds the dictionary and its hash. ``blocks`` holds one row
per block of about a megabyte of ids: the block's bytes, and beside them the range of documents and
the number of tokens, by which a reader prunes and numbers blocks. Blocks lie in ascending
``doc_id`` order, shard after shard. Bytes of a block, little-endian::

    magic "TKB1" | dictionary hash (16) | documents n (u32) | id width in bytes (u8)
    doc ids (i64 x n) | null flags (u8 x n) | token counts (u32 x n) | frame offsets (u64 x (n + 1)) | frames

A frame is the zstandard compression of one document's ids, so a short document is read by its two
offsets alone (``read_document``). Parquet only carries the blocks: Spark's commit protocol then
makes the file complete or absent, on any store Spark can write, whatever executors are lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.llm.common import doc_text
from trawlight.llm.tokens import END_ID, encoder

_MAGIC = b"TKB1"
_HEAD = struct.Struct("<4s16sIB")
_BLOCK_BYTES = 1 << 20
_LEVEL = 3

_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("start_in_shard", pa.int64()),
        ("n_docs", pa.int32()),
        ("n_tokens", pa.int64()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("has_null", pa.bool_()),
        ("payload", pa.binary()),
    ]
)
_BLOCK_DDL = (
    "shard int, block long, start_in_shard long, n_docs int, n_tokens long, "
    "first_doc long, last_doc long, has_null boolean, payload binary"
)


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _width(vocabulary: str) -> int:
    return 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(
    docs: DataFrame, vocabulary: str, sample_docs: int = 1000, sample_tokens: int = 4096, size: int = 64 << 10
) -> bytes:
    """A dictionary trained on the serialised ids of at most ``sample_docs`` documents.

    The sample are the documents of the smallest ``xxhash64(doc_id)``, of each at most
    ``sample_tokens`` ids. The dictionary decides the size of a token file, never its content.
    Samples too few or too alike to train on are joined to a plain dictionary; none give none.
    """
    sample = (
        doc_text(docs).where(F.col("text") != "").orderBy(F.xxhash64("doc_id"), "text").limit(sample_docs).select("text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(vocabulary)
        for batch in batches:
            for _, ids, bounds in encoder(vocabulary).blocks(batch.column(0)):
                cut = [ids[a : min(b, a + sample_tokens)] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict({"ids": [_narrow(part.tobytes(), width) for part in cut]})

    samples = [bytes(row["ids"]) for row in sample.mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack_block(docs: list[tuple[int | None, bytes]], width: int, dictionary: bytes) -> bytes:
    """The bytes of one block from ``(doc_id, ids as unsigned 32-bit)``."""
    compressor = zstandard.ZstdCompressor(level=_LEVEL, dict_data=_dictionary(dictionary))
    return _pack(docs, width, dictionary_hash(dictionary), compressor)


def _pack(docs, width, digest, compressor) -> bytes:
    frames = [compressor.compress(_narrow(ids, width)) for _, ids in docs]
    return b"".join(
        [
            _HEAD.pack(_MAGIC, digest, len(docs), width),
            np.array([doc or 0 for doc, _ in docs], "<i8").tobytes(),
            np.array([doc is None for doc, _ in docs], "<u1").tobytes(),
            np.array([len(ids) // 4 for _, ids in docs], "<u4").tobytes(),
            np.array([0, *accumulate(map(len, frames))], "<u8").tobytes(),
            *frames,
        ]
    )


class Block:
    """Reads a block; only the asked documents are decompressed."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, digest, n, self.width = _HEAD.unpack_from(payload)
        if magic != _MAGIC or digest != dictionary_hash(dictionary):
            raise ValueError("not a block of this token file")
        self.payload, at = payload, _HEAD.size
        ids = np.frombuffer(payload, "<i8", n, at).tolist()
        nulls = np.frombuffer(payload, "<u1", n, at + 8 * n).tolist()
        self.doc_ids = [None if null else doc for doc, null in zip(ids, nulls)]
        self.counts = np.frombuffer(payload, "<u4", n, at + 9 * n).tolist()
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 13 * n).tolist()
        self.frames = at + 13 * n + 8 * (n + 1)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, place: int) -> np.ndarray:
        """The ids of one document, as unsigned 32-bit integers."""
        frame = self.payload[self.frames + self.offsets[place] : self.frames + self.offsets[place + 1]]
        raw = self.decompressor.decompress(frame)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, dictionary: bytes | None = None) -> None:
    """Write the ids of all whole texts, each followed by ``END_ID``, in ascending ``doc_id`` order.

    Null texts are empty; they, and empty texts, hold the end id alone. A null ``doc_id`` comes
    first. Rows of one ``doc_id`` all stay, ordered by text. Other columns are not read. An empty
    table gives a file without blocks. Texts are shuffled once, by ranges of ``doc_id``, and encoded
    where they are written, so a task holds one block at a time.
    """
    spark = docs.sparkSession
    if dictionary is None:
        dictionary = train_dictionary(docs, vocabulary)
    digest = dictionary_hash(dictionary)
    spark.createDataFrame([(digest, dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, width = TaskContext.get().partitionId(), _width(vocabulary)
        compressor = zstandard.ZstdCompressor(level=_LEVEL, dict_data=_dictionary(dictionary))
        number, start = 0, 0

        def close(held):
            nonlocal number, start
            tokens = sum(len(ids) for _, ids in held) // 4
            known = [doc for doc, _ in held if doc is not None]
            row = [shard, number, start, len(held), tokens, min(known, default=None), max(known, default=None)]
            row += [len(known) < len(held), _pack(held, width, digest, compressor)]
            number, start = number + 1, start + tokens
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        held, size = [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in encoder(vocabulary).blocks(batch.column(1)):
                for place, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
                    held.append((doc_ids[place], ids[a:b].tobytes() + end))
                    size += len(held[-1][1])
                    if size >= _BLOCK_BYTES:
                        yield close(held)
                        held, size = [], 0
        if held:
            yield close(held)

    ordered = doc_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, _BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


def _stored_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, n_bytes)`` of every document, from the files.

    ``start`` counts the ids of all documents before; its base per shard comes from one sum per
    shard. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, ``n_bytes`` the
    compressed size.
    """
    dictionary = _stored_dictionary(spark, path)
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases = dict(zip([row["shard"] for row in sums], accumulate([row["n"] for row in sums], initial=0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["payload"], dictionary)
                sums = [zlib.crc32(block.ids(place).tobytes()) for place in range(len(block.doc_ids))]
                starts = bases[row["shard"]] + row["start_in_shard"] + np.cumsum([0, *block.counts], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(block.doc_ids, pa.int64()),
                        "start": pa.array(starts[:-1], pa.int64()),
                        "n_tokens": pa.array(block.counts, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                        "n_bytes": pa.array(np.diff(np.array(block.offsets, np.int64))),
                    }
                )

    return blocks.select("shard", "start_in_shard", "payload").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row that carries the id); only blocks that span it are read."""
    dictionary = _stored_dictionary(spark, path)
    found = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks").where(
        (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)
    )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block(payload, dictionary)
                ids = [block.ids(place).tolist() for place, doc in enumerate(block.doc_ids) if doc == doc_id]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.list_(pa.int64()))})

    rows = found.orderBy("shard", "block").select("payload").mapInArrow(pick, "ids array<long>").collect()
    return [list(row["ids"]) for row in rows]
