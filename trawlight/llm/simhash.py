"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A covering family for radius r has ``2^(r+1) - 1`` masks over the 64 bits: bit i carries a vector
m(i) of r + 1 bits, and the mask of a vector v keeps the bits with an odd product <m(i), v>. The vectors of
at most r differing bits span less than the whole space, so some v is orthogonal to all of them:
its mask keeps none of those bits, and the two fingerprints fall into the same bucket of its table.
Every pair within the radius is therefore met, with no chance of a miss.

Texts become fingerprints first and equal fingerprints one row, so groups of exact copies of any
size are one member. A bucket of up to ``BUCKET`` fingerprints is compared in one task and gives a
spanning forest of its links. Fingerprints of larger buckets are linked through midpoints instead:
two fingerprints are within 4 bits exactly if some value lies within 2 bits of both, and at most
2,081 fingerprints lie within 2 bits of a value, so those groups are bounded and none is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlight.llm.common import doc_text, lower_words_of, release_memory
from trawlight.session import materialise

RADIUS = 4
SHINGLE = 4
BUCKET = 1024
_SEED = 42
_ALL = (1 << 64) - 1
_PLANES = 256 * np.arange(8)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = lower_words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 16):
        part = spans[at : at + (1 << 16)]
        hashes = np.array([digest(joined[a:b], _SEED) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def _shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; none without words."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - width + 1)].tolist()
    stops = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def _majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, from how often each byte has each value."""
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + _PLANES
    counts = np.bincount(planes.ravel(), minlength=8 * 256).reshape(8, 256) @ _BITS_OF_BYTE
    return int(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").ravel().view("<u8")[0])


def families(text: str, width: int, count: int) -> list[int]:
    """``count`` SimHash fingerprints of a text, each from hashes mixed anew; zeros without words."""
    hashes, found = _shingle_hashes(text, width), []
    for number in range(count):
        mixed = (hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 & _ALL)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        found.append(_majority_bits(mixed * np.uint64(0xD6E8FEB86659FD93)) if len(hashes) else 0)
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of all whole texts, ``fp`` as a signed long; null texts have no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py()) for text in batch.column(1)]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(signed)], ["doc_id", "fp"])

    return doc_text(docs).mapInArrow(hashed, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks of a covering family, as signed 64-bit integers."""
    vectors = [bit % ((2 << radius) - 1) + 1 for bit in range(64)]
    masks = []
    for v in range(1, 2 << radius):
        mask = sum(1 << bit for bit, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def spanning_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all members reachable from each other by steps within the radius."""
    values = members.view(np.uint64)
    open_ = np.ones(len(values), bool)
    links = []
    for root in range(len(values)):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(values ^ values[at]) <= radius))
            open_[near] = False
            links += [(int(members[at]), int(members[i])) for i in near]
            front += near.tolist()
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, by: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect every pair within the radius.

    With ``by`` columns fingerprints link only inside a family, and the links carry these columns.
    The midpoints of crowded buckets need a radius that halves and balls that stay small, so the radius is 0, 2 or 4.
    """
    if radius not in (0, 2, 4):
        raise ValueError("the radius is 0, 2 or 4")
    masks = F.array(*[F.lit(mask).cast("long") for mask in covering_masks(radius)])
    # A slot is a hash of table and key, which moves fewer bytes; a collision puts more fingerprints
    # together, whose distances are compared in any case.
    table, key = F.col("table"), F.col("fp").bitwiseAND(F.col("mask"))
    slots = distinct.select(*by, "fp", F.posexplode(masks).alias("table", "mask")).select(
        *by, F.xxhash64(*by, table, key).alias("slot"), "fp"
    )
    sizes = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialise(sizes, "buckets")
    largest = sizes.agg(F.max("n")).first()[0] or 0

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for row, members in enumerate(batch.column(batch.num_columns - 1)):
                links = spanning_links(members.values.to_numpy(), radius)
                found += links
                owners += [row] * len(links)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            own = [column.take(pa.array(owners, pa.int64())) for column in batch.columns[:-1]]
            ends = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            yield pa.RecordBatch.from_arrays([*own, *ends], [*batch.schema.names[:-1], "a", "b"])

    small = slots.join(sizes.where(F.col("n") <= bucket), "slot")
    groups = small.groupBy(*by, "slot").agg(F.collect_list("fp").alias("members")).select(*by, "members")
    kinds = [f"{name} {distinct.schema[name].dataType.simpleString()}" for name in by]
    links = groups.mapInArrow(link, ", ".join([*kinds, "a long", "b long"]))
    if largest > bucket:
        crowded = slots.join(sizes.where(F.col("n") > bucket), "slot").select(*by, "fp").distinct()
        links = links.unionByName(midpoint_links(crowded, radius, by))
    return links.distinct()


def midpoint_links(crowded: DataFrame, radius: int = RADIUS, by: tuple[str, ...] = ()) -> DataFrame:
    """Links between fingerprints that share a value within half the radius of both."""
    bits = [flips for size in range(radius // 2 + 1) for flips in combinations(range(64), size)]
    flips = [sum(1 << bit for bit in chosen) for chosen in bits]
    signed = F.array(*[F.lit(flip - (1 << 64) if flip >> 63 else flip).cast("long") for flip in flips])
    balls = crowded.select(*by, "fp", F.explode(signed).alias("flip")).select(
        *by, "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")
    )
    met = balls.groupBy(*by, "middle").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return met.select(*by, F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 4096)).alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every linked node; ``root`` is the smallest node of its component.

    Alternates large-star and small-star steps: each node's larger neighbours, then its smaller
    ones, are hung on the smallest neighbour. Every round is a handful of joins and aggregations over
    at most as many edges as before, stored in the shared folder; only a count and a checksum of the
    edges reach the driver.
    """
    low, high = F.least("a", "b").alias("p"), F.greatest("a", "b").alias("v")
    edges = materialise(links.where("a != b").select(high, low).distinct(), "edges")

    def state(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "p"))).first()

    before = state(edges)
    while before[0]:
        both = edges.select(F.col("v").alias("u"), F.col("p").alias("w")).unionByName(
            edges.select(F.col("p").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("p")).distinct()
        large = materialise(large, "large-star")
        root = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(root, "v").where("p != m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        edges = materialise(small.unionByName(root.select("v", F.col("m").alias("p"))).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    own_root = edges.select(F.col("p").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(own_root)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Documents are linked at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` that links lead to. Repeated rows give one row each. Rows without a ``doc_id`` take
    part as links; a component of such rows alone has the id null. Texts that are null, empty or
    white space have fingerprint zero and are linked like others. An empty table stays empty.
    """
    stored = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(stored.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    member = components(near_links(distinct.select("fp"), radius))
    linked = distinct.join(member, distinct["fp"] == member["node"]).select("fp", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    ids = linked.join(smallest, "root").select(F.col("fp").alias("linked"), "component")
    of_fp = distinct.join(ids, F.col("fp") == F.col("linked"), "left").select(
        "fp", F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id")
    )
    return stored.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, row: str, width: int = 5, count: int = 4, radius: int = RADIUS) -> DataFrame:
    """``row`` of one document of each group of near-duplicates: of the smallest ``doc_id``, then the smallest ``row``.

    ``row`` is a column that numbers the rows of ``docs``, so repeated and null ids do not matter; an id comes
    before none. A text has ``count`` fingerprints of its ``width``-word shingles, and two texts
    link if those of any one family differ in at most ``radius`` bits: texts whose similarity one
    fingerprint would often miss have as many more chances. All rows of texts without words are one group. Null and
    empty texts have no words; an empty table stays empty; other columns play no part.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [families(text.as_py() or "", width, count) for text in batch.column(2)]
            signed = np.array(values, np.uint64).reshape(-1, count).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(list(signed), pa.list_(pa.int64()))],
                ["row", "doc_id", "fps"],
            )
        release_memory()

    narrow = docs.select(F.col(row).cast("long"), docs["doc_id"], docs["text"])
    stored = materialise(narrow.mapInArrow(hashed, "row long, doc_id long, fps array<long>"), "families")
    # Of equal texts only the first row goes on.
    order = Window.partitionBy("fps").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    first = stored.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    first = materialise(first, "distinct-texts")
    held = first.select("row", F.posexplode("fps").alias("family", "fp"))
    node = materialise(held.groupBy("family", "fp").agg(F.min("row").alias("node")), "fingerprint-rows")
    same = held.join(node, ["family", "fp"]).select(F.col("row").alias("a"), F.col("node").alias("b")).where("a != b")
    near = near_links(node.select("family", "fp"), radius, by=("family",))
    ends = [node.select("family", F.col("fp").alias(end), F.col("node").alias(f"node_{end}")) for end in ("a", "b")]
    linked = near.join(ends[0], ["family", "a"]).join(ends[1], ["family", "b"])
    links = same.unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    group = materialise(components(links), "near-groups").withColumnRenamed("node", "row")
    grouped = first.select("row", "doc_id").join(group, "row")
    kept = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    chosen = grouped.withColumn("_place", F.row_number().over(kept)).where("_place = 1").select("row")
    alone = first.select("row").join(group.select("row"), "row", "left_anti")
    return chosen.unionByName(alone).withColumnRenamed("row", row)
