"""Vector codes: each part of a vector becomes the number of the nearest entry of its codebook.

The nearest entry is found by Orchard's search. Every entry keeps the other entries of its codebook
sorted by distance. A search goes along the list of the best entry so far, jumps to the list of a
better one as soon as it meets it, and passes over entries it has marked as visited. By the triangle
inequality no entry that lies beyond twice the current distance from the best one can be nearer, so
the search stops there. Components are whole numbers and distances squared, so nothing is rounded.

All searches of a block run in step: one array holds the best entry of each, another the place in
its list, a third the visited entries as bits. Codebooks are small and fixed in size; vectors never
leave their tasks, which send one row of sums per codebook entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlight.llm.topk import usable
from trawlight.session import materialise

SCALE = 256
PARTS = 16
ENTRIES = 64  # visited entries are the bits of one number
ROUNDS = 2
_BLOCK_ROWS = 4096
_FAR = np.iinfo(np.int64).max


class Codebooks:
    """``entries`` (parts x entries x width), with the neighbour list of every entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, count, width = entries.shape
        gaps = np.zeros((parts, count, count), np.int64)
        for dimension in range(width):
            gaps += np.square(entries[:, :, None, dimension] - entries[:, None, :, dimension])
        # Ties in a list go to the lower entry; an entry leads its own list and is skipped by its mark.
        self.near = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.near, axis=2)
        # Start of a search: the entry whose sum of components is nearest.
        sums = entries.sum(axis=2)
        self.by_sum = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.by_sum, axis=1)

    def _start(self, vectors: np.ndarray) -> np.ndarray:
        start = np.empty(vectors.shape[:2], np.int64)
        count = self.sums.shape[1]
        for part in range(vectors.shape[1]):
            place = np.searchsorted(self.sums[part], vectors[:, part].sum(axis=1))
            start[:, part] = self.by_sum[part, np.minimum(place, count - 1)]
        return start.ravel()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entry, squared distance)`` of each part of ``vectors`` (rows x parts x width).

        Of entries at the same distance the lowest wins: an entry at exactly twice the distance is
        still looked at, and an equally near one of a lower number counts as better.
        """
        rows, parts, width = vectors.shape
        count = self.entries.shape[1]
        points = vectors.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        best = self._start(vectors)
        distance = np.square(points - self.entries[part, best]).sum(axis=1)
        visited = np.left_shift(np.uint64(1), best.astype(np.uint64))
        place = np.zeros(len(points), np.int64)
        active = np.arange(len(points))
        while len(active):
            own, at, top = part[active], place[active], best[active]
            gap = np.where(at < count, self.gaps[own, top, np.minimum(at, count - 1)], _FAR)
            # Twice the distance is four times its square.
            going = gap <= 4 * distance[active]
            active, own, at, top = active[going], own[going], at[going], top[going]
            met = self.near[own, top, at]
            place[active] = at + 1
            bit = np.left_shift(np.uint64(1), met.astype(np.uint64))
            new = (visited[active] & bit) == 0
            fresh, met, own, bit = active[new], met[new], own[new], bit[new]
            visited[fresh] |= bit
            found = np.square(points[fresh] - self.entries[own, met]).sum(axis=1)
            better = (found < distance[fresh]) | ((found == distance[fresh]) & (met < best[fresh]))
            jump = fresh[better]
            best[jump], distance[jump], place[jump] = met[better], found[better], 0
        return best.reshape(rows, parts), distance.reshape(rows, parts)

    def sha256(self) -> str:
        """Hash of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vector: Column, dims: int) -> Column:
    """``floor(256 x)`` of each component, filled up to ``dims`` with zeros."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def _blocks(batch: pa.RecordBatch, column: int, parts: int, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows of a batch in blocks: first, last, vectors (rows x parts x width)."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
    for first in range(0, batch.num_rows, _BLOCK_ROWS):
        some = flat[first : first + _BLOCK_ROWS]
        yield first, first + len(some), some.reshape(len(some), parts, dims // parts)


def _moved(kept: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """The codebooks whose entries are the rounded-down means of the parts assigned to them."""
    parts, count, width = books.entries.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * count, width), np.int64)
        sizes = np.zeros(parts * count, np.int64)
        for batch in batches:
            for _, _, vectors in _blocks(batch, 0, parts, dims):
                slot = (books.nearest(vectors)[0] + np.arange(parts) * count).ravel()
                sizes += np.bincount(slot, minlength=len(sizes))
                np.add.at(sums, slot, vectors.reshape(-1, width))
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(sums[used].ravel()),
                pa.array(np.repeat(sizes[used], width)),
            ],
            names=["slot", "place", "total", "members"],
        )

    added = kept.select("vector").mapInArrow(add_up, "slot int, place int, total long, members long")
    means = added.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    entries = books.entries.reshape(parts * count, width).copy()
    for slot, place, total, members in means.collect():  # at most as many as the codebooks have components
        entries[slot, place] = total // members
    return Codebooks(entries.reshape(books.entries.shape))


def encode(
    vectors: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of every usable row.

    Vectors that are null or hold null or non-finite components are left out. Components become
    ``floor(256 x)``. Shorter vectors are filled up with zeros to the longest, and all of them to a
    multiple of ``parts``. A codebook starts from the rows of the ``entries`` smallest keys (all, if there are
    fewer; equal keys by their vectors, null keys never); ``rounds`` times every part goes to its nearest entry, ties to the lower
    one, and entries become the rounded-down means of their parts; unused entries stay. ``code`` has two
    hex digits per part, ``error`` is the sum of the squared distances, ``label_error`` the sum over all rows of equal
    label, null labels together. Repeated rows are coded one by one. An empty table, or one without
    any key, gives no rows. Other columns play no part.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
    usable_rows = vectors.where(usable(vectors[vector])).select(
        vectors[key].cast("long").alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("vector")
    )
    longest = usable_rows.agg(F.max(F.size("vector"))).first()[0] or 0
    dims = max(1, -(-longest // parts)) * parts
    whole = usable_rows.select("vec_id", "label", whole_numbers(F.col("vector"), dims).alias("vector"))
    kept = materialise(whole, "vectors")
    first = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries).select("vector").collect()
    if not first:
        return _coded(kept.limit(0), Codebooks(np.zeros((parts, 1, dims // parts), np.int64)), dims)
    books = Codebooks(
        np.array([row["vector"] for row in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    )
    for _ in range(rounds):
        books = _moved(kept, books, dims)
    return _coded(kept, books, dims)


def _coded(kept: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    parts, label_type = books.entries.shape[0], kept.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, some in _blocks(batch, 2, parts, dims):
                entry, distance = books.nearest(some)
                codes = entry.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        batch.column(1)[first:last],
                        pa.array([row.tobytes().hex() for row in codes], pa.string()),
                        pa.array(distance.sum(axis=1)),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    coded = materialise(
        kept.select("vec_id", "label", "vector").mapInArrow(assign, f"vec_id long, label {label_type}, code string, error long"),
        "codes",
    )
    by_label = coded.groupBy(F.col("label").alias("_tl_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(materialise(by_label, "label-errors"), F.col("label").eqNullSafe(F.col("_tl_label")))
    return joined.select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
