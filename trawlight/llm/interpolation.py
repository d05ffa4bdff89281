"""Language-model scores by deleted interpolation of bigrams, unigrams and an unknown-word class.

``P(w | h) = a_b c(h w) / c(h) + b_b c(w) / N + u_b [w unknown]``, where the weights depend on the
bucket b of the context's frequency (its number of binary digits). Weights are learned by
expectation-maximisation: one fold of the training documents is deleted from the counts, and the
weights make that fold most likely under what is left. Scores use the counts of all training documents.

Counts come from the whole corpus and are found again for every text, so the n-grams have to meet
by shuffle; as rows they would be several times the corpus. Texts are therefore stored in chunks of
some megabytes. A chunk sends its distinct n-grams, 64-bit hashes in ascending order with their
counts, as one block to each shard of the hash range. A shard adds up the blocks and answers each
with the total counts in the same order. Blocks of a frequent word are no longer than others: it
is one entry per chunk. The number of shards follows the number of chunks, so neither side
grows with the corpus. Distinct words share a hash with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlight.llm.common import crc_remainder, doc_text
from trawlight.session import materialise

FOLDS = 7
HELD_OUT = 2
DELETED = 4
CHUNK_BYTES = 8 << 20
_END, _START = 1, 2
_BUCKETS = 64
_CELL = 4  # cells per doubling of a probability
_ROUNDS = 100

_CHUNK = "chunk long, deleted boolean, payload binary"
_ANSWER = "chunk long, gram int, shard int, answer binary, tokens long, words long"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Compressed integer arrays, byte plane by byte plane."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(types, sizes):
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def _store(doc_ids: list, texts: list) -> bytes:
    table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole texts in chunks; the deleted fold has chunks of its own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held = {False: ([], []), True: ([], [])}
        sizes = {False: 0, True: 0}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            row = {"chunk": [number], "deleted": [deleted], "payload": [_store(*held[deleted])]}
            number, held[deleted], sizes[deleted] = number + 1, ([], []), 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                deleted = crc_remainder(doc_id, FOLDS) == DELETED
                held[deleted][0].append(doc_id)
                held[deleted][1].append(text.as_py())
                sizes[deleted] += len(held[deleted][1][-1])
                if sizes[deleted] >= chunk_bytes:
                    yield close(deleted)
        for deleted in (False, True):
            if held[deleted][0]:
                yield close(deleted)

    return doc_text(docs).mapInArrow(build, _CHUNK)


class Chunk:
    """The tokens of a chunk: hashes of lower-cased words, an end after each text."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.doc_ids = table.column(0).to_pylist()
        texts = pc.ascii_lower(table.column(1).chunk(0))
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.array([max(digest(word.encode()), 3) for word in distinct], np.uint64)
        words = hashes[coded.indices.to_numpy()]
        self.ends = bounds[1:] + np.arange(len(bounds) - 1)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.tokens = np.full(len(words) + len(self.ends), _END, np.uint64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.ends] = False
        self.tokens[inner] = words
        remainders = [crc_remainder(doc_id, FOLDS) for doc_id in self.doc_ids]
        self.learns = np.array([r is not None and r != HELD_OUT for r in remainders], bool)

    def grams(self, size: int) -> np.ndarray:
        if size == 1:
            return self.tokens
        before = np.concatenate([[np.uint64(_START)], self.tokens[:-1]])
        before[self.starts] = _START
        mixed = before * np.uint64(0x9E3779B97F4A7C15) + self.tokens
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else values[:0]


def _edges(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


def blocks(stored: DataFrame, shards: int) -> DataFrame:
    """One row per chunk, n-gram size and shard: distinct n-grams and their training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(shards)
        for batch in batches:
            for number, deleted, payload in zip(*(column.to_pylist() for column in batch.columns)):
                chunk = Chunk(payload)
                learns = np.repeat(chunk.learns, chunk.ends - chunk.starts + 1)
                for size in (1, 2):
                    keys, place = np.unique(chunk.grams(size), return_inverse=True)
                    counts = np.bincount(place[learns], minlength=len(keys)).astype(np.uint32)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    steps = np.diff(keys, prepend=np.uint64(0))
                    for _, a, _ in parts:
                        steps[a] = keys[a]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "gram": pa.array([size] * len(parts), pa.int32()),
                            "shard": pa.array([i for i, _, _ in parts], pa.int32()),
                            "chunk": pa.array([number] * len(parts), pa.int64()),
                            "deleted": pa.array([deleted] * len(parts)),
                            "block": [_squeeze(steps[a:b], counts[a:b]) for _, a, b in parts],
                        }
                    )

    return stored.select("chunk", "deleted", "payload").mapInArrow(
        send, "gram int, shard int, chunk long, deleted boolean, block binary"
    )


def _add_up(blocks_of_shard: pd.DataFrame) -> pd.DataFrame:
    """Answers for the blocks of one shard: total counts, for deleted chunks also those of the rest."""
    frame = blocks_of_shard.sort_values("chunk")
    parts = [_expand(block, "<u8", "<u4") for block in frame["block"]]
    keys = [np.cumsum(steps, dtype=np.uint64) for steps, _ in parts]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([count for _, count in parts])
    total = np.bincount(place, counts, len(distinct)).astype(np.uint64)
    rest = np.repeat(~frame["deleted"].to_numpy(bool), [len(k) for k in keys])
    kept = np.bincount(place[rest], counts[rest], len(distinct)).astype(np.uint64)
    answers, at = [], 0
    for own, deleted in zip(keys, frame["deleted"]):
        found = place[at : at + len(own)]
        answers.append(_squeeze(total[found], kept[found]) if deleted else _squeeze(total[found]))
        at += len(own)
    out = frame[["chunk", "gram", "shard"]].copy()
    out["answer"] = answers
    out["tokens"], out["words"] = 0, 0
    summed = pd.DataFrame(
        {"chunk": [-1, -2], "gram": frame["gram"].iloc[0], "shard": frame["shard"].iloc[0], "answer": [b"", b""]}
    )
    summed["tokens"] = [int(total.sum()), int(kept.sum())]
    summed["words"] = [int((total > 0).sum()), int((kept > 0).sum())]
    return pd.concat([out, summed])


def _counts(chunk: Chunk, answers: list, deleted: bool, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: counts of the bigram, of the word and of the context. ``which``: 0 all, 1 without
    the deleted fold, which only the answers to deleted chunks hold."""
    found = {}
    for size in (1, 2):
        own = sorted((a for a in answers if a["gram"] == size), key=lambda a: a["shard"])
        kinds = ["<u8"] * (2 if deleted else 1)
        full = [_expand(a["answer"], *kinds)[which] for a in own]
        place = np.unique(chunk.grams(size), return_inverse=True)[1]
        found[size] = np.concatenate(full).astype("f8")[place]
    context = np.concatenate([[0.0], found[1][:-1]])
    context[chunk.starts] = found[1][chunk.ends]  # a start is as frequent as an end
    return found[2], found[1], context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context)[1].clip(0, _BUCKETS - 1)


def _events(batches: Iterator[pa.RecordBatch], kept_tokens: int) -> Iterator[pa.RecordBatch]:
    """Tokens of deleted chunks, summed up by bucket and by cells of their two probabilities."""
    for batch in batches:
        for row in batch.to_pylist():
            two, one, context = _counts(Chunk(row["payload"]), row["answers"], True, 1)
            p2, p1 = two / np.maximum(context, 1), one / max(kept_tokens, 1)
            with np.errstate(divide="ignore"):
                cells = [np.where(p > 0, np.round(_CELL * -np.log2(p)), -1).clip(-1, 999) for p in (p2, p1)]
            key = (_bucket(context) * 1000 + cells[0] + 1) * 1000 + cells[1] + 1
            distinct, place = np.unique(key.astype(np.int64), return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": distinct,
                    "n": np.bincount(place).astype(np.int64),
                    "p2": np.bincount(place, p2),
                    "p1": np.bincount(place, p1),
                }
            )


def learn_weights(cells: pd.DataFrame, rounds: int = _ROUNDS) -> np.ndarray:
    """Weights (bucket x bigram, unigram, unknown) by expectation-maximisation over counted cells.

    Each bucket starts from an even mixture and from one virtual token of each kind, so no weight is
    zero; a bucket without held-out tokens takes the weights of all of them together.
    """
    n = cells["n"].to_numpy("f8")
    bucket = (cells["cell"].to_numpy("i8") // 1_000_000).astype(int)
    p2, p1 = cells["p2"].to_numpy("f8") / n, cells["p1"].to_numpy("f8") / n
    parts = np.stack([p2, p1, (p1 == 0).astype("f8")], axis=1)

    def em(rows: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            shares = parts[rows] * weights
            shares /= np.maximum(shares.sum(1, keepdims=True), 1e-300)
            weights = (shares * n[rows, None]).sum(0) + 1
            weights /= weights.sum()
        return weights

    everything = em(np.ones(len(n), bool))
    return np.array([em(bucket == b) if (bucket == b).any() else everything for b in range(_BUCKETS)])


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every whole text under the model that the training documents give.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of
    ``docs``. Training documents are those whose ``crc32(doc_id)`` modulo 7 is not 2; one remainder
    among them (4) is the deleted fold. ``base_score`` is the add-one unigram score. Null, empty and
    blank texts hold the end token alone. A null ``doc_id`` is scored, but not learned from and neither
    held out nor not. Repeated rows count, and are scored, each. An empty table stays empty.
    """
    stored = materialise(chunks(docs, chunk_bytes), "chunks")
    shards = max(8, stored.count())
    dealt = blocks(stored, shards).groupBy("gram", "shard").applyInPandas(_add_up, _ANSWER)
    answers = materialise(dealt, "answers")
    sums = {
        row["chunk"]: (row["t"], row["w"])
        for row in answers.where("chunk < 0 and gram = 1")
        .groupBy("chunk")
        .agg(F.sum("tokens").alias("t"), F.sum("words").alias("w"))
        .collect()
    }
    tokens, words = sums.get(-1, (0, 0))
    kept_tokens = sums.get(-2, (0, 0))[0]
    lists = (
        answers.where("chunk >= 0")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("gram", "shard", "answer")).alias("answers"))
    )
    joined = stored.join(lists, "chunk").select("deleted", "payload", "answers")
    cells = (
        joined.where("deleted")
        .mapInArrow(lambda batches: _events(batches, kept_tokens), "cell long, n long, p2 double, p1 double")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    )
    # At most one row per cell: buckets x cells x cells, whatever the corpus.
    weights = learn_weights(cells.orderBy("cell").toPandas())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column(1)[i].as_py())
                two, one, context = _counts(chunk, batch.column(2)[i].as_py(), batch.column(0)[i].as_py(), 0)
                w = weights[_bucket(context)]
                p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(tokens, 1) + w[:, 2] * (one == 0)
                base = np.log10((one + 1) / (tokens + words + 1))
                remainders = [crc_remainder(doc_id, FOLDS) for doc_id in chunk.doc_ids]
                n = len(chunk.doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(chunk.doc_ids, pa.int64()),
                        "held_out": pa.array([r if r is None else r == HELD_OUT for r in remainders], pa.bool_()),
                        "n_tokens": pa.array(chunk.ends - chunk.starts + 1, pa.int64()),
                        "n_known": pa.array(chunk.per_doc((one > 0).astype(np.int64)), pa.int64()),
                        "train_tokens": pa.array([tokens] * n, pa.int64()),
                        "base_score": pa.array(chunk.per_doc(base), pa.float64()),
                        "score": pa.array(chunk.per_doc(np.log10(p)), pa.float64()),
                    }
                )

    return joined.mapInArrow(
        rate,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
