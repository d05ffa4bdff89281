"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are packed in groups of bounded size, dealt by a hash of the row, so no task sees all of
them; only lengths and keys move. Inside a group best fit decreasing makes the first bins. Local
search then works on the bins that are not full: a piece moves, or one or two pieces are exchanged for one or
two smaller ones, whenever the sum of squared fills rises, until the
emptier bin is empty or nothing helps. Bins that stay below ``poor_fill`` are packed again with
those of many other groups, until one group is left or nothing is gained.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlight.llm.common import doc_text
from trawlight.llm.tokens import END_ID, encoder
from trawlight.session import materialise

SEQUENCE_TOKENS = 4096
GROUP_PIECES = 8_000
POOR_FILL = 0.995

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: token ids and end id of every whole text, cut
    every ``capacity`` tokens. A null text is empty: one piece that holds the end id."""
    end = np.array([END_ID], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, bounds in encoder(vocabulary).blocks(batch.column(1)):
                rows = {"doc": [], "piece": [], "start": [], "length": [], "crc": []}
                for place, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
                    own = np.concatenate([ids[a:b], end])
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows["doc"].append(place)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(len(part))
                        rows["crc"].append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(rows["doc"], pa.int64())).cast(pa.int64()),
                        pa.array(rows["piece"], pa.int32()),
                        *(pa.array(rows[name], pa.int64()) for name in ("start", "length", "crc")),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return doc_text(docs).mapInArrow(cut, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each piece goes to the fullest bin that has room. Bins of places."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # ascending (room left, bin)
    for place in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[place]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, chosen = room.pop(at)
            bins[chosen].append(place)
        else:
            left, chosen = capacity, len(bins)
            bins.append([place])
        if left > size:
            insort(room, (left - size, chosen))
    return bins


class _Underfull:
    """Bins with room, and for any number of tokens those where they fit best.

    A bin takes tokens in exchange for none, one or two of its pieces, ``back`` tokens in all. The
    sorted list ``ways`` holds ``(room + back, back, bin)`` for every bin and every such sum, so the
    exchange that leaves the least room is found by bisection.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in held) for held in bins]
        self.ways: list[tuple[int, int, int]] = []
        for number in range(len(bins)):
            self.ways += self._ways_of(number)
        self.ways.sort()

    def sums(self, number: int) -> dict[int, tuple[int, ...]]:
        """One or two pieces of a bin by their total; the fewer pieces, the better."""
        by_length: dict[int, list[int]] = {}
        for piece in self.bins[number]:
            by_length.setdefault(self.lengths[piece], []).append(piece)
        found = {length: (same[0],) for length, same in by_length.items()}
        own = sorted(by_length)
        for i, a in enumerate(own):
            for b in own[: i + 1]:
                if a != b:
                    found.setdefault(a + b, (by_length[a][0], by_length[b][0]))
                elif len(by_length[a]) > 1:
                    found.setdefault(a + b, tuple(by_length[a][:2]))
        return found

    def _ways_of(self, number: int) -> list[tuple[int, int, int]]:
        room = self.capacity - self.fill[number]
        if not room or not self.bins[number]:
            return []
        return [(room + back, back, number) for back in (0, *self.sums(number))]

    def open(self, number: int) -> None:
        for way in self._ways_of(number):
            insort(self.ways, way)

    def close(self, number: int) -> None:
        for way in self._ways_of(number):
            del self.ways[bisect_left(self.ways, way)]

    def best(self, giver: int) -> tuple[int, tuple[int, ...], int, int] | None:
        """``(tokens, pieces, back, taker)`` that leaves a taker the least room; None if nothing helps.

        The squared fills of the two rise exactly if the taker ends fuller than the giver was.
        """
        least, step = None, None
        for tokens, pieces in self.sums(giver).items():
            at = bisect_left(self.ways, (tokens,))
            while at < len(self.ways):
                reach, back, taker = self.ways[at]
                if least is not None and reach - tokens >= least:
                    break
                if back < tokens and self.fill[taker] + tokens - back > self.fill[giver]:
                    least, step = reach - tokens, (tokens, pieces, back, taker)
                    break
                at += 1
        return step

    def exchange(self, giver: int, tokens: int, pieces: tuple[int, ...], back: int, taker: int) -> None:
        self.close(taker)
        returned = self.sums(taker)[back] if back else ()
        for source, target, moved in ((giver, taker, pieces), (taker, giver, returned)):
            for piece in moved:
                self.bins[source].remove(piece)
                self.bins[target].append(piece)
        self.fill[taker] += tokens - back
        self.fill[giver] -= tokens - back
        self.open(taker)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins until bins empty; never more bins than before.

    The emptiest bins give first. A step moves one piece or two to another bin, for none, one or two
    smaller in exchange, and raises the sum of squared fills. Partners are looked up by length, among all
    bins with room. It goes on until no bin can give anything or no fewer bins are possible; the sum is
    a whole number and bounded, so it comes to rest.
    """
    state = _Underfull([list(held) for held in bins], lengths, capacity)
    left, least = len(bins), -(-sum(lengths) // capacity)
    moved = True
    while moved and left > least:
        moved = False
        givers = (i for i in range(len(bins)) if state.bins[i] and state.fill[i] < capacity)
        for giver in sorted(givers, key=lambda i: (state.fill[i], i)):
            if not state.bins[giver] or state.fill[giver] == capacity:
                continue
            state.close(giver)
            while state.bins[giver] and (step := state.best(giver)):
                state.exchange(giver, *step)
                moved = True
            state.open(giver)
            left -= not state.bins[giver]
            if left <= least:
                break
    return [held for held in state.bins if held]


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Equal rows are separate pieces; rows are numbered once and stored with their number. A null
    length raises an error: every row has to be placed.
    Sequence ids are unique, not dense; offsets are gapless from 0 within a sequence. All other
    columns stay; those named ``sequence_id`` or ``offset`` are kept as ``sequence_id_in`` and ``offset_in``,
    and names that start with ``_tl_`` are taken. An empty table stays empty.
    """
    number, order, fill, group, place = (f"_tl_{name}" for name in ("row", "bin", "fill", "group", "place"))
    pieces = pieces.withColumnsRenamed({name: f"{name}_in" for name in ("sequence_id", "offset")})
    columns = pieces.columns
    rows = materialise(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == capacity).select(
        *columns, (-F.col(number) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = rows.where(F.col("length").isNull() | (F.col("length") != capacity))
    schema = f"{number} long, length long, {group} long, {order} long, {place} long, {fill} long"

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(number, ignore_index=True)
        lengths = frame["length"].astype("int64").tolist()
        bins = pack_group(lengths, capacity)
        at = [i for held in bins for i in held]
        out = frame.iloc[at].copy()
        out[order] = np.repeat(np.arange(len(bins)), [len(held) for held in bins])
        out[place] = [end - lengths[i] for held in bins for i, end in zip(held, np.cumsum([lengths[j] for j in held]))]
        out[fill] = out.groupby(order)["length"].transform("sum")
        return out[[number, "length", group, order, place, fill]]

    done, base = [], 0
    todo = rest.select(number, "length")
    count = todo.count()
    while count:
        groups = math.ceil(count / group_pieces)
        dealt = todo.withColumn(group, base + F.pmod(F.xxhash64(number), F.lit(groups)))
        packed = materialise(dealt.repartition(groups, group).groupBy(group).applyInPandas(solve, schema), "packed")
        good = F.col(fill) >= capacity * POOR_FILL
        again = packed.where(~good)
        left = again.count() if groups > 1 else 0
        if left == 0 or math.ceil(left / group_pieces) >= groups:
            done.append(packed)
            break
        done.append(packed.where(good))
        todo, count, base = again.select(number, "length"), left, base + groups
    if not done:
        return full
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    placed = packed.select(
        number, (F.col(group) * (1 << 24) + F.col(order)).alias("sequence_id"), F.col(place).alias("offset")
    )
    return full.unionByName(rest.join(placed, number).select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Cut all documents and pack the pieces: ``cut_pieces`` columns, ``sequence_id``, ``offset``.

    Only ``doc_id`` and ``text`` play a part, so other columns may have any name. Whole texts of any length are
    encoded; null and empty ones are one piece of one token. Repeated rows are packed one by one.
    """
    return pack(cut_pieces(docs, vocabulary, capacity), capacity)
