"""Exact top-k inner products by columnar branch-and-bound.

Vectors lie in blocks in vertical layout: one row per dimension. A task meets one block of queries
with one block of candidates and adds up scores a few dimensions at a time. After each step what
the remaining dimensions can still add is bounded by the product of the remaining norms
(Cauchy-Schwarz); candidates that cannot reach any query's k-th best score are compacted away.
Dimensions are taken by falling energy, and every query starts from its k-th best score among a
bounded sample of candidates, so the bounds bite early. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlight.session import materialise, number_and_count

SCALE = 64
K = 20
_BLOCK_ROWS = 4096
_QUERY_ROWS = 1024
_QUERY_GROUP = 64
_DIMENSIONS = 16
_SAMPLE_ROWS = 2048

_BLOCK = "block long, n int, dims int, ids binary, slots binary, cells binary"


def _block_row(ids: list[int], slots: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    """One block; shorter vectors are filled up with zeros, which add nothing to a product."""
    dims = max((len(row) for row in rows), default=0)
    cells = np.zeros((dims, len(rows)), "<f8")
    for i, row in enumerate(rows):
        cells[: len(row), i] = row
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([slots[0]], pa.int64()),
            "n": pa.array([len(rows)], pa.int32()),
            "dims": pa.array([dims], pa.int32()),
            "ids": [np.array(ids, "<i8").tobytes()],
            "slots": [np.array(slots, "<i8").tobytes()],
            "cells": [cells.tobytes()],
        }
    )


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors from ``(slot, vec_id, vector)``; components become ``floor(64 x)``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slots, rows = [], [], []
        for batch in batches:
            for slot, vec_id, vector in zip(*(batch.column(i) for i in range(3))):
                slots.append(slot.as_py())
                ids.append(vec_id.as_py())
                rows.append(np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False).astype("f8")))
                if len(rows) == size:
                    yield _block_row(ids, slots, rows)
                    ids, slots, rows = [], [], []
        if rows:
            yield _block_row(ids, slots, rows)

    return vectors.mapInArrow(build, _BLOCK)


def _cells(row: dict, order: np.ndarray | None = None) -> np.ndarray:
    cells = np.frombuffer(row["cells"], "<f8").reshape(row["dims"], row["n"])
    return cells if order is None else cells[order]


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = max(len(a), len(b))
    return tuple(np.pad(x, ((0, dims - len(x)), (0, 0))) if len(x) < dims else x for x in (a, b))


def scan(queries, query_ids, candidates, candidate_ids, floor, k):
    """``(query place, candidate place, score)`` of all that can be among a query's k best.

    ``queries`` and ``candidates`` are (dimensions x vectors); ``floor`` is a score per query that
    at least k candidates of the whole table reach, or minus infinity.
    """
    queries, candidates = _fit(queries, candidates)
    order = np.argsort(-np.square(candidates).sum(1), kind="stable")
    queries, candidates = queries[order], candidates[order]
    steps = range(0, len(order), _DIMENSIONS)
    rest_q = np.array([np.sqrt(np.square(queries[s:]).sum(0)) for s in (*steps, len(order))])
    rest_c = np.array([np.sqrt(np.square(candidates[s:]).sum(0)) for s in (*steps, len(order))])
    places, hits, scores = [], [], []
    for first in range(0, queries.shape[1], _QUERY_GROUP):
        group = slice(first, first + _QUERY_GROUP)
        low = floor[group].astype("f8").copy()
        alive = np.arange(candidates.shape[1])
        part = np.zeros((len(low), len(alive)))
        for at, start in enumerate(steps):
            rows = slice(start, start + _DIMENSIONS)
            part += queries[rows, group].T @ candidates[rows][:, alive]
            left = rest_q[at + 1, group][:, None] * rest_c[at + 1, alive][None, :]
            # One unit covers the rounding of the norms; scores are whole numbers.
            keep = (part + left + 1 >= low[:, None]).any(0)
            if keep.sum() <= 0.8 * len(alive):
                alive, part = alive[keep], part[:, keep]
        same = query_ids[group][:, None] == candidate_ids[alive][None, :]
        part = np.where(same, -np.inf, part)
        if len(alive) > k:
            best = np.partition(part, len(alive) - k, axis=1)[:, len(alive) - k]
            low = np.maximum(low, best)
        q, c = np.nonzero((part >= low[:, None]) & np.isfinite(part))
        found = part[q, c]
        # Ties at the k-th score are settled by id, so cut each query's list only after sorting it.
        rank = np.lexsort((candidate_ids[alive[c]], -found, q))
        q, c, found = q[rank], c[rank], found[rank]
        starts = np.searchsorted(q, np.arange(len(low)))
        top = np.arange(len(q)) - starts[q] < k
        places.append(q[top] + first)
        hits.append(alive[c[top]])
        scores.append(found[top])
    return np.concatenate(places), np.concatenate(hits), np.concatenate(scores)


def usable(vector: Column) -> Column:
    """True for vectors that are not null and whose components are all finite."""
    finite = F.forall(
        vector,
        lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)),
    )
    return F.coalesce(finite, F.lit(False))


def top_k(
    candidates: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query row.

    Components become ``floor(64 x)``; scores are exact whole numbers as long as they stay below
    2^53. Ties go to the smaller id. A query meets every candidate row with another id. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part; shorter
    vectors are filled up with zeros. Repeated candidate rows are separate candidates; repeated query rows
    are answered one by one. Empty tables give no rows. Other columns play no part. Blocks of queries, which are
    fewer, are copied to the blocks of candidates, which are moved once; a query keeps k rows per
    block for the final ranking.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        used = rows.where(rows[key].isNotNull() & usable(rows[vector]))
        return used.select(
            F.monotonically_increasing_id().alias("slot"), rows[key].cast("long").alias("vec_id"), rows[vector]
        )

    held = materialise(blocks(numbered(candidates), _BLOCK_ROWS), "candidate-blocks")
    asked = materialise(blocks(numbered(queries), _QUERY_ROWS), "query-blocks")
    sample = _sample(candidates, vector, key)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                floor = np.full(row["n"], -np.inf)
                if sample is not None:
                    ids = np.frombuffer(row["ids"], "<i8")
                    q, c = _fit(_cells(row), sample[1])
                    scores = np.where(ids[:, None] == sample[0][None, :], -np.inf, q.T @ c)
                    if scores.shape[1] > k:
                        floor = np.partition(scores, -k, axis=1)[:, -k]
                row |= {"floor": floor.astype("<f8").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_with_floor)

    _with_floor = pa.schema(
        [("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32())]
        + [(name, pa.binary()) for name in ("ids", "slots", "cells", "floor")]
    )
    ready = materialise(asked.mapInArrow(floors, _BLOCK + ", floor binary"), "query-floors")
    blocks_held, count = number_and_count(held.select("block"), ["block"], "number", 0)
    dealt = held.join(blocks_held, "block").repartition(max(count, 1), "number")
    copied = ready.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count, 1) - 1).cast("long"))).alias("number"),
        F.struct("n", "dims", "ids", "slots", "cells", "floor").alias("asked"),
    )
    pairs = dealt.select(F.col("number").cast("long"), F.struct("n", "dims", "ids", "cells").alias("held")).join(
        copied.repartition(max(count, 1), "number").hint("shuffle_merge"), "number"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held_row, asked_row = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                query_ids = np.frombuffer(asked_row["ids"], "<i8")
                ids = np.frombuffer(held_row["ids"], "<i8")
                floor = np.frombuffer(asked_row["floor"], "<f8")
                q, c, scores = scan(_cells(asked_row), query_ids, _cells(held_row), ids, floor, k)
                slots = np.frombuffer(asked_row["slots"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (slots[q], query_ids[q], ids[c], scores.astype(np.int64))],
                    ["slot", "query_id", "vec_id", "score"],
                )

    met = pairs.mapInArrow(score, "slot long, query_id long, vec_id long, score long")
    order = Window.partitionBy("slot", "query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _sample(candidates: DataFrame, vector: str, key: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and cells of at most ``_SAMPLE_ROWS`` candidates, those of the smallest hash."""
    used = candidates.where(candidates[key].isNotNull() & usable(candidates[vector]))
    rows = (
        used.select(candidates[key].cast("long").alias("id"), candidates[vector].alias("v"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(_SAMPLE_ROWS)
        .collect()
    )
    if not rows:
        return None
    vectors = [np.floor(SCALE * np.array(row["v"], "f8")) for row in rows]
    cells = np.zeros((max(map(len, vectors)), len(rows)))
    for i, v in enumerate(vectors):
        cells[: len(v), i] = v
    return np.array([row["id"] for row in rows], np.int64), cells
