"""Exact Jaccard join of documents as shingle sets, through a token-group matrix.

Equal sets become one. Sets are numbered so that similar ones follow each other (by size class and
least shingle hash) and cut into groups of ``GROUP``; a group keeps the union of its members' first tokens.
A set meets only groups whose union it overlaps enough, and only these groups are opened.

Which cells of the matrix are looked at is exact, too. Two sets within the threshold differ in at most
H tokens, a share of their size; if the range of hashes is cut into H + 1 parts, both have the same
tokens in one of them. So each set has a signature per part, for sets of its own size class and of
the next, and a set meets a group if they share a signature. Unrelated texts share single shingles by
chance, ever more of them as a corpus grows, but hardly the eight or so of a whole part.
Of two sorted sets within the threshold the first ``n - ceil(share * n) + 1`` hashes share one, and what the
others can add to an overlap is bounded by their number, which gives the bound of a set with a group.

The matrix is met group by group: a part and a group make one cell, which holds as bits the members that have
the part, and cells with equal parts meet. So the cells of a big cluster of near copies meet as its square divided by
that of ``GROUP``, and only bits are aggregated. A row of what follows is a pair of groups, too: the sets of the one and the
bits or members of the other meet inside it.

A qualifying group is opened in two steps, both exact. A set's sketch has one byte for each of some fine ranges of
hashes, a sum over the tokens there; as many bytes as differ, so many tokens at least do. Only the pairs whose sketches
allow a link have their whole sets compared. Still, a big cluster has many links. So groups are opened in
rounds. Each set is first compared with one other, which is the first at most of its signatures; then with
the nearest member of each group that qualifies, and last with all members that are left. What links connect needs no
further comparison: a signature whose sets are all connected leaves the matrix, and a set passes over members that are
connected with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlight.llm.common import doc_text
from trawlight.llm.shingle_sets import mixed, shingle_sets
from trawlight.llm.simhash import components
from trawlight.session import materialise, number_and_count

WIDTH = 3
SHARE = 90
GROUP = 64  # a group's members are the bits of a long
_SALT = np.uint64(0xA0761D6478BD642F)
# A sketch has at least so many bytes for each token in which two sets within the threshold may differ.
_FINE = 4


def size_class(n: int, share: int = SHARE) -> int:
    """Sizes within the threshold of each other are in one class or in neighbouring ones."""
    return int(math.log(n) / _class_width(share))


def _class_width(share: int) -> float:
    return math.log(100 / share) * (1 + 1e-9)


@cache
def _part_edges(number: int, share: int) -> np.ndarray:
    """Where the parts of the hash range begin, for pairs whose larger set is in the class ``number``."""
    largest = math.ceil(math.exp((number + 1) * _class_width(share))) + 1
    parts = 2 * (100 - share) * largest // (100 + share) + 1
    return np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)


def signatures(tokens: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Hashes of the tokens in each part, for pairs in the set's size class and in the next one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens), dtype=np.uint64)])
    found, own = [], size_class(len(tokens), share)
    for number in (own, own + 1):
        edges = _part_edges(number, share)
        ends = sums[np.concatenate([np.searchsorted(tokens, edges), [len(tokens)]])]
        held = ends - np.concatenate([[np.uint64(0)], ends[:-1]])
        place = np.arange(len(held), dtype=np.uint64) + np.uint64(number << 40)
        found.append(mixed(held ^ mixed(place + _SALT)))
    return np.concatenate(found)


def sketch(tokens: np.ndarray, share: int = SHARE) -> np.ndarray:
    """One byte per equal range of hashes: the sum of its tokens' scrambled hashes. The number of ranges is a power of two."""
    bits = max(3, math.ceil(math.log2(max(1, _FINE * 2 * (100 - share) * len(tokens) / (100 + share)))))
    begins = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens), dtype=np.uint64)])
    return np.diff(sums[np.append(begins, len(tokens))]).astype(np.uint8)


def _folded(sketches: np.ndarray, length: int) -> np.ndarray:
    """Sketches of wider ranges: the sums of ranges beside each other added up."""
    return sketches.reshape(*sketches.shape[:-1], length, -1).sum(axis=-1, dtype=np.uint8)


def differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bytes a sketch differs from each row of others, in the wider ranges of the two."""
    length = min(one.shape[-1], others.shape[-1])
    return (_folded(others, length) != _folded(one, length)).sum(axis=1)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all binary values, and where each one begins."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), at


def _nearby(rows: DataFrame, share: int, every: bool) -> DataFrame:
    """``(a, b, others)``: the pairs whose sketches allow a link, of rows ``(asking, members)``, lists of sets.

    A set meets later ones of another cluster. Of the members of a row that it may link to all, or the nearest
    with how many others there are.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (own_ends, own), (ends, held) = (_lists(batch.column(place)) for place in (0, 1))
            (own_data, own_at), (data, at) = _bytes_of(own["sketch"]), _bytes_of(held["sketch"])
            found = []
            for row in range(batch.num_rows):
                first, last = ends[row], ends[row + 1]
                lengths = np.diff(at[first : last + 1])
                for asker in range(own_ends[row], own_ends[row + 1]):
                    n, sizes = own["n"][asker], held["n"][first:last]
                    able = (held["number"][first:last] > own["number"][asker]) & (held["cluster"][first:last] != own["cluster"][asker])
                    able &= 100 * np.minimum(n, sizes) >= share * np.maximum(n, sizes)
                    left = n + sizes - 2 * -(-share * (n + sizes) // (100 + share))
                    apart = np.full(last - first, np.iinfo(np.int64).max)
                    for length in np.unique(lengths[able]):
                        same = np.flatnonzero(able & (lengths == length))
                        bytes_held = data[at[first + same][:, None] + np.arange(length)]
                        apart[same] = differing(own_data[own_at[asker] : own_at[asker + 1]], bytes_held)
                    near = np.flatnonzero(apart <= left)
                    if len(near):
                        chosen = near if every else near[[np.argmin(apart[near])]]
                        others = np.full(len(chosen), len(near) - len(chosen))
                        found.append((np.full(len(chosen), own["number"][asker]), held["number"][first + chosen], others))
            if found:
                columns = [pa.array(np.concatenate(column), pa.int64()) for column in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "others"])

    return rows.select("asking", "members").mapInArrow(compare, "a long, b long, others long")


def _lists(column: pa.Array) -> tuple[np.ndarray, dict]:
    """Where the list of each row begins, and the fields of all lists' structs, numbers as arrays."""
    fields = {field.name: column.values.field(field.name) for field in column.type.value_type}
    return column.offsets.to_numpy(), {name: held.to_numpy() if pa.types.is_integer(held.type) else held for name, held in fields.items()}


def _able(rows: DataFrame, share: int) -> DataFrame:
    """``(own_group, group, asking, members)``: ``asking`` without the sets whose overlap with a group's union allows no link.

    Only first tokens are compared; the rest of a set adds at most its number.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_group, group, asking, members, lowest, highest, smallest, largest = (column.to_numpy() for column in batch.columns[:8])
            ends, own = _lists(batch.column(8))
            token_ends, tokens = own["tokens"].offsets.to_numpy(), own["tokens"].values.to_numpy()
            union_ends, unions = batch.column(9).offsets.to_numpy(), batch.column(9).values.to_numpy()
            left = np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                first, last = ends[row], ends[row + 1]
                n, number, cluster = (own[name][first:last] for name in ("n", "number", "cluster"))
                able = (asking[row] >> number % GROUP) & 1 == 1
                able &= (lowest[row] != cluster) | (highest[row] != cluster)
                able &= (100 * largest[row] >= share * n) & (100 * n >= share * smallest[row])
                held = np.isin(tokens[token_ends[first] : token_ends[last]], unions[union_ends[row] : union_ends[row + 1]])
                counts = np.diff(np.concatenate([[0], np.cumsum(held)])[token_ends[first : last + 1] - token_ends[first]])
                # The smallest size that a member within the threshold can have asks for the least overlap.
                size = np.maximum(smallest[row], -(-share * n // 100))
                most = counts + np.maximum(-(-share * n // 100), -(-share * largest[row] // 100)) - 1
                able &= most >= -(-share * (n + size) // (100 + share))
                left[row] = np.bitwise_or.reduce(np.int64(1) << number[able] % GROUP, initial=0)
            some = left != 0
            arrays = [pa.array(values[some], pa.int64()) for values in (own_group, group, left, members)]
            yield pa.RecordBatch.from_arrays(arrays, ["own_group", "group", "asking", "members"])

    names = ["own_group", "group", "asking", "members", "lowest", "highest", "smallest", "largest", "own", "union"]
    return rows.select(*names).mapInArrow(bound, "own_group long, group long, asking long, members long")


def _set_ids(batches: Iterator[pa.RecordBatch], width: int):
    """Per block of texts: batch, first place, sets, and the sets' 128-bit hashes (null without words)."""
    for batch in batches:
        for first, sets in shingle_sets(batch.column(1), width):
            yield batch, first, sets, [xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None for tokens in sets]


def measured(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``(doc_id, n, sig, low, parts)`` of every text: set size, hash of the set, least token, signatures.

    Sets too small to be within the threshold of any other have no signatures.
    """
    least = least_size(share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, sets, ids in _set_ids(batches, width):
            parts = [signatures(tokens, share) if len(tokens) >= least else tokens[:0] for tokens in sets]
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[first : first + len(sets)].cast(pa.int64()),
                    pa.array([len(tokens) for tokens in sets], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([int(tokens[:1].view(np.int64)[0]) if len(tokens) else None for tokens in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n", "sig", "low", "parts"],
            )

    schema = "doc_id long, n long, sig binary, low long, parts array<long>"
    return doc_text(docs).mapInArrow(measure, schema)


def least_size(share: int) -> float:
    """The size of the smallest set that another set can be within the threshold of."""
    return share / (100 - share) if share < 100 else math.inf


def _group(number: Column) -> Column:
    return F.floor(number / GROUP).cast("long")


class _Sets:
    """The distinct sets that share a signature with another one, in groups, with their tokens.

    ``shared`` is ``(part, number, n)``, ``whole`` is ``(number, n, tokens, sketch)``.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame, distinct: DataFrame, width: int, share: int):
        self.share = share
        # Of the rows with equal sets all but one are left out. Where these are few, they are broadcast and signatures stay in place.
        copies = materialise(rows.where("n > 0").select("slot").join(distinct.select("slot"), "slot", "left_anti"), "copies")
        first = rows.where(F.size("parts") > 0).join(copies, "slot", "left_anti")
        parts = first.select("slot", F.explode("parts").alias("part"))
        common = materialise(parts.groupBy("part").count().where("count > 1").select("part"), "shared-parts")
        met = materialise(parts.join(common, "part"), "sets-of-parts")
        playing = rows.select("slot", "sig", "n", "low").join(met.select("slot").distinct(), "slot", "left_semi")
        ordered = playing.withColumn("class", F.floor(F.log("n") / math.log(1.05)))
        numbered, _ = number_and_count(ordered, ["class", "low", "sig"], "number", 0)
        self.numbers = numbered.select("number", "slot", "sig", "n")
        self.shared = materialise(met.join(self.numbers.select("slot", "number", "n"), "slot").drop("slot"), "shared")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, sets, ids in _set_ids(batches, width):
                ends = np.cumsum([0, *map(len, sets)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                sketches = pa.array([sketch(held, share).tobytes() for held in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), tokens, sketches], names=["sig", "tokens", "sketch"])

        wanted = materialise(self.numbers.join(distinct.select("slot", "first"), "slot"), "wanted-sets")
        ids = wanted.select(F.col("first").alias("_tl_id")).distinct()
        texts = doc_text(docs)
        texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_tl_id"]), "left_semi")
        sets = texts.mapInArrow(whole, "sig binary, tokens array<long>, sketch binary").join(wanted.select("number", "n", "sig"), "sig")
        self.whole = materialise(sets.dropDuplicates(["sig"]).select("number", "n", "tokens", "sketch"), "whole-sets")

    def prefix(self) -> Column:
        """The first tokens of a set, one of which any set within the threshold shares."""
        return F.slice("tokens", 1, (F.col("n") - F.ceil(self.share * F.col("n") / 100) + 1).cast("int"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` of numbers whose whole sets are within the threshold."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
        whole = self.whole.select("number", "tokens").join(asked, "number", "left_semi")
        of_a = whole.select(F.col("number").alias("a"), F.col("tokens").alias("of_a"))
        of_b = whole.select(F.col("number").alias("b"), F.col("tokens").alias("of_b"))
        both = pairs.join(of_a, "a").join(of_b, "b").where(self._within("of_a", "of_b"))
        return materialise(both.select("a", "b"), "set-links")

    def _within(self, a: str, b: str) -> Column:
        """Whether two whole sets are within the threshold."""
        common = F.size(F.array_intersect(a, b))
        return (100 + self.share) * common >= self.share * (F.size(a) + F.size(b))

    def first_pairs(self) -> DataFrame:
        """Each set with the set that is first at most of its signatures."""
        hubs = self.shared.groupBy("part").agg(F.min("number").alias("hub"))
        others = self.shared.join(hubs, "part").where("hub <> number")
        counted = others.groupBy("number", "hub").agg(F.count(F.lit(1)).alias("common"))
        best = Window.partitionBy("number").orderBy(F.desc("common"), "hub")
        chosen = counted.withColumn("_place", F.row_number().over(best)).where("_place = 1")
        alone = F.array(F.struct("number", "n", "sketch", F.col("number").alias("cluster")))
        members = self.whole.select("number", alone.alias("members"))
        asking = self.whole.select(F.col("number").alias("hub"), alone.alias("asking"))
        rows = chosen.select("number", "hub").join(members, "number").join(asking, "hub")
        return materialise(_nearby(rows, self.share, every=True).select("a", "b"), "first-pairs")

    def qualifying(self, root: DataFrame) -> DataFrame:
        """``(own_group, group, asking, members)``: groups whose sets may link and are not connected so far.

        A pair is met once: a group meets itself and those after it. ``asking`` has the bits of the sets of the first
        that may link to one of the second, ``members`` of those there that share a signature with any set of the first.
        """
        rows = self.shared.join(root, "number", "left").withColumn("cluster", F.coalesce("root", "number")).drop("root")
        ends = rows.groupBy("part").agg(F.min("cluster").alias("lowest"), F.max("cluster").alias("highest"))
        rows = rows.join(ends.where("lowest < highest").select("part"), "part", "left_semi")
        cells = rows.groupBy("part", _group(F.col("number")).alias("group")).agg(
            F.min("cluster").alias("lowest"),
            F.max("cluster").alias("highest"),
            F.bit_or(F.expr(f"shiftleft(1L, cast(number % {GROUP} as int))")).alias("members"),
        )
        cells = materialise(cells, "matrix")
        asking = cells.select(
            "part", *[F.col(name).alias(f"own_{name}") for name in ("group", "lowest", "highest", "members")]
        )
        apart = F.least("lowest", "own_lowest") < F.greatest("highest", "own_highest")
        met = asking.join(cells, "part").where((F.col("group") >= F.col("own_group")) & apart)
        met = met.groupBy("own_group", "group").agg(
            F.bit_or("own_members").alias("asking"),
            F.bit_or("members").alias("members"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
        )
        met = materialise(met, "met-groups")
        sets = self._clustered(root, "number", "n", self.prefix().alias("tokens"))
        groups = met.select(F.explode(F.array("own_group", "group")).alias("group")).distinct()
        held = sets.groupBy("group").agg(
            F.collect_list(F.struct("number", "n", "cluster", "tokens")).alias("own"),
            F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"),
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
        )
        held = materialise(held.join(groups, "group", "left_semi"), "prefix-unions")
        both = met.join(held.drop("own"), "group").join(held.select(F.col("group").alias("own_group"), "own"), "own_group")
        return materialise(_able(both, self.share), "qualifying-groups")

    def _clustered(self, root: DataFrame, *columns: str | Column) -> DataFrame:
        """Columns of ``whole``, ``cluster`` and ``group`` of every set; a set that no link connects is a cluster alone."""
        sets = self.whole.select(*columns).join(root, "number", "left")
        return sets.withColumn("cluster", F.coalesce("root", "number")).withColumn("group", _group(F.col("number"))).drop("root")

    def opened(self, qualified: DataFrame, root: DataFrame, every: bool) -> DataFrame:
        """``(a, b, others)``: a set with the members of its qualifying groups whose sketches allow a link, all or the nearest."""
        sets = self._clustered(root, "number", "n", "sketch")
        held = sets.groupBy("group").agg(F.collect_list(F.struct("number", "n", "sketch", "cluster")).alias("held"))

        def among(held: str, bits: str) -> Column:
            return F.filter(held, lambda member: F.getbit(bits, (member["number"] % GROUP).cast("int")) == 1)

        rows = qualified.join(held, "group").withColumn("members", among("held", "members")).drop("held", "group")
        own = held.withColumnRenamed("group", "own_group")
        rows = rows.join(own, "own_group").select(among("held", "asking").alias("asking"), "members")
        return materialise(_nearby(rows, self.share, every), "opened-groups")

    def all_links(self) -> DataFrame:
        """Links that connect whatever links connect, found round by round."""
        links = self.links(self.first_pairs())
        for every in (False, True):
            root = materialise(components(links), "connected").withColumnRenamed("node", "number")
            pairs = self.opened(self.qualifying(root), root, every)
            links = links.unionByName(self.links(pairs.select("a", "b")))
            if not pairs.where("others > 0").head(1):
                break
        return links


def similar_sets(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    A document's set are its distinct shingles of ``width`` words, A-Z lower-cased; of fewer words the
    whole sequence. Documents link when ``100 * intersection >= share * union``; ``component_id`` is
    the smallest ``doc_id`` that links lead to. A document without words or text has an empty
    set, links with nothing and keeps its own id. Repeated rows give one row each and are linked by
    their equal sets. Rows without a ``doc_id`` take part as links; a component of such rows alone has a null id.
    Whole texts of any length count; other columns play no part. An empty table stays empty.

    Shingles and sets are told apart by hashes of 64 and 128 bits.
    """
    rows = measured(docs, width, share)
    rows = materialise(rows.withColumn("slot", F.monotonically_increasing_id()), "shingle-sets")
    distinct = rows.where("n > 0").groupBy("sig").agg(F.min("slot").alias("slot"), F.min("doc_id").alias("first"))
    distinct = materialise(distinct, "distinct-sets")
    sets = _Sets(docs, rows, distinct, width, share)
    roots = materialise(components(sets.all_links()), "roots").select(F.col("node").alias("number"), "root")
    members = sets.numbers.select("number", "slot").join(roots, "number").join(distinct.select("slot", "first"), "slot")
    smallest = members.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = members.join(smallest, "root").select(F.col("slot").alias("linked"), "component")
    of_set = distinct.join(of_linked, F.col("slot") == F.col("linked"), "left").select(
        "sig", F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("component")).alias("component")
    )
    of_set = materialise(of_set.withColumnRenamed("sig", "_tl_sig"), "set-components")
    found = rows.select("doc_id", "n", "sig").join(of_set, F.col("sig") == F.col("_tl_sig"), "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )
