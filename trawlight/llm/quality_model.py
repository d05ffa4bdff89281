"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is fitted on all trusted documents but those held out for the limits. Counting is Spark
work: trigram counts, continuation counts, discounts and interpolation are aggregations and joins,
sharded by n-gram and context. Finished tables of up to ``BROADCAST_NGRAMS`` rows are sorted once,
broadcast, and joined to the n-grams of all documents batch by batch where the texts are. Larger ones
stay sharded and packed, from the counts of blocks of texts on. Then a text's log probability is written as a sum of
weights of its words, bigrams and trigrams, which a join by n-gram finds: blocks of texts send their n-grams, packed, to
the shards of the model and get the sums for each text back. A document is kept if its perplexity is at most a
quantile of the trusted documents of its language that the model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trawlight.llm.common import release_memory
from trawlight.session import Scratch, materialise

# Tables with more rows than this are joined by shuffle; with fewer, the driver and the workers hold them.
BROADCAST_NGRAMS = 4_000_000
# The n-grams of a larger model are joined in so many rounds, each with a share of the n-grams, to hold less on disk at a time.
ROUNDS = 8
# So many rounds count its trigrams, each those of a share of the contexts.
COUNT_ROUNDS = 3
# So many ids of documents to train on are broadcast, at most; with more, the texts are shuffled by id.
BROADCAST_IDS = 4_000_000
QUANTILE = 0.99
SLACK = 1.25
MIN_WORDS = 20
HELD_FOLDS = 4
LEAST_HELD = 20
_JUDGED = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]"
_PAD = 0
_BLOCK_BYTES = 4 << 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, and where texts begin."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), ends[words.offsets.to_numpy() - words.offsets[0].as_py()]


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the place of every word among them, and where texts begin."""
    words, bounds = _words(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(word.encode()) or 1 for word in distinct], np.uint64).view(np.int64)
    return hashes, coded.indices.to_numpy().astype(np.int64), bounds


def text_blocks(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("f8")))
    first = 0
    while first < len(texts):
        limit = (ends[first - 1] if first else 0) + _BLOCK_BYTES
        last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
        yield texts.slice(first, last - first)
        first = last


def _history(codes: np.ndarray, bounds: np.ndarray, back: int, pad: int) -> np.ndarray:
    """The code ``back`` places before each word of its text, or ``pad``."""
    out = np.full(len(codes), pad, codes.dtype)
    out[back:] = codes[:-back]
    for shift in range(back):
        starts = bounds[:-1] + shift
        out[starts[starts < bounds[1:]]] = pad
    return out


def trigrams(texts: DataFrame) -> DataFrame:
    """``(w1, w2, w3, c)``: counts of word trigrams by 64-bit word hash, texts padded in front."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                hashes, codes, bounds = _word_codes(block)
                words = hashes[codes]
                rows = pd.DataFrame(
                    {"w1": _history(words, bounds, 2, _PAD), "w2": _history(words, bounds, 1, _PAD), "w3": words}
                )
                counted = rows.groupby(["w1", "w2", "w3"], sort=False).size().reset_index(name="c")
                yield pa.RecordBatch.from_pandas(counted.astype("int64"), preserve_index=False)

    found = texts.select("text").mapInArrow(count, "w1 long, w2 long, w3 long, c long")
    # Dealt out by their context, trigrams are not shuffled again for sums over it.
    return found.repartition("w1", "w2").groupBy("w1", "w2", "w3").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    return _discounts_of(dict(counts.where("c <= 4").groupBy("c").count().collect()))


def _discounts_of(found: dict[int, int]) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; clipped to their ranges where counts are too few."""
    n1, n2, n3, n4 = (max(found.get(i, 0), 1) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(raw, 1)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


@dataclass
class Model:
    """Sorted tables of an n-gram model. Word places: 0 ... n - 1 known, n padding, n + 1 unknown."""

    words: np.ndarray
    word_p: np.ndarray
    word_back: np.ndarray
    pairs: np.ndarray
    pair_p: np.ndarray
    pair_back: np.ndarray
    triples: np.ndarray
    triple_p: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every word, and where texts begin."""
        n = len(self.words)
        hashes, codes, bounds = _word_codes(texts)
        at, known = self._find(self.words, hashes)
        word = np.where(known, at, n + 1)[codes]
        before, earlier = _history(word, bounds, 1, n), _history(word, bounds, 2, n)
        pair, has_pair = self._find(self.pairs, before * (n + 2) + word)
        context, has_context = self._find(self.pairs, earlier * (n + 2) + before)
        triple, has_triple = self._find(self.triples, np.where(has_context, context, -1) * (n + 2) + word)
        has_triple &= has_context
        p = np.where(has_pair, _at(self.pair_p, pair), self.word_back[before] + self.word_p[word])
        p = np.where(has_context, _at(self.pair_back, context), 0) + p
        return np.where(has_triple, _at(self.triple_p, triple), p), bounds


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values[places] if len(values) else np.zeros(len(places))


@dataclass
class _Stored:
    """A small model as stored tables: ``words (w3, p, back)``, ``pairs (a, b, p, back)``, ``triples (w1, w2, w3, p)``.

    ``back`` is the mass that a word or pair leaves as a context. Padding is the word 0.
    """

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame
    unknown: float


@dataclass
class Tables:
    """What a large model adds to log probabilities: ``weights (shard, n, keys, ends, follows)``, packed.

    ``ends`` is what an n-gram adds where it ends, ``follows`` where it is a context. A word counts from the unknown word on,
    a bigram from the probability that its word has after the context's mass, a trigram from that of its bigram. So the sum
    over all known n-grams that end with a word is the logarithm of the interpolated probability of the longest one.
    """

    weights: DataFrame
    bits: int
    unknown: float
    scratch: Scratch


def fit(texts: DataFrame) -> Model:
    """The model of the ``text`` column in memory; its size must suit the driver."""
    return _in_memory(_stored(texts))


def _stored(texts: DataFrame) -> _Stored:
    """Interpolated modified Kneser-Ney of order 3 over the ``text`` column. Without words every
    word is unknown."""
    scratch = Scratch(texts.sparkSession)
    over = Window.partitionBy("w1", "w2")
    sums = [F.sum("c").over(over).alias("sum"), *[F.sum(F.when(F.least("c", F.lit(3)) == i, 1).otherwise(0)).over(over).alias(f"n{i}") for i in (1, 2, 3)]]
    tri = scratch.store("trigrams", trigrams(texts).select("w1", "w2", "w3", "c", *sums))
    # A lower order counts the different words before an n-gram; nothing stands before padding.
    bi = scratch.store(
        "bigrams",
        tri.groupBy("w2", "w3").agg(
            F.when(F.col("w2") == _PAD, F.sum("c")).otherwise(F.count(F.lit(1))).alias("c")
        ),
    )
    uni = scratch.store("unigrams", bi.groupBy("w3").agg(F.count(F.lit(1)).alias("c")))
    d1, d2, d3 = _discounts(uni), _discounts(bi), _discounts(tri)
    size, total, held = uni.agg(F.count(F.lit(1)), F.sum("c"), F.sum(_discount(d1))).first()
    size, total, held = size or 0, total or 1, held or 1.0
    unknown = held / total / (size + 1)
    mass = F.sum(_discount(d2)) / F.sum("c")
    contexts = scratch.store("contexts", bi.groupBy("w2").agg(F.sum("c").alias("sum"), mass.alias("mass")))
    uni_p = uni.select("w3", ((F.col("c") - _discount(d1)) / total + unknown).alias("p"))
    words = uni_p.join(contexts.select(F.col("w2").alias("w3"), F.col("mass").alias("back")), "w3", "full")
    words = scratch.store("words", words)
    own = (F.col("c") - _discount(d2)) / F.col("sum")
    bi_p = scratch.store(
        "bigram-p",
        bi.join(contexts, "w2").join(uni_p, "w3").select("w2", "w3", (own + F.col("mass") * F.col("p")).alias("p")),
    )
    scratch.drop("bigrams", "unigrams", "contexts")
    left = (d3[0] * F.col("n1") + d3[1] * F.col("n2") + d3[2] * F.col("n3")) / F.col("sum")
    masses = tri.groupBy(F.col("w1").alias("a"), F.col("w2").alias("b")).agg(F.first(left).alias("back"))
    pairs = scratch.store("pairs", bi_p.select(F.col("w2").alias("a"), F.col("w3").alias("b"), "p").join(masses, ["a", "b"], "full"))
    scratch.drop("bigram-p")
    following = pairs.where(F.col("p").isNotNull()).select(F.col("a").alias("w2"), F.col("b").alias("w3"), "p")
    own = (F.col("c") - _discount(d3)) / F.col("sum")
    triples = scratch.store(
        "trigram-p",
        tri.select("w1", "w2", "w3", own.alias("own"), left.alias("mass"))
        .join(following, ["w2", "w3"])
        .select("w1", "w2", "w3", (F.col("own") + F.col("mass") * F.col("p")).alias("p")),
    )
    scratch.drop("trigrams")
    return _Stored(words, pairs, triples, unknown)


def _n_words(texts: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([len(_words(block)[0])], pa.int64())], ["n"])
        release_memory()

    return texts.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


_TRIGRAMS = "shard long, n long, v long, words binary, codes binary, counts binary"
_COUNTED = f"share long, {_TRIGRAMS}, t1 long, t2 long, t3 long, t4 long"


def fit_tables(texts: DataFrame, least: int = 0) -> Tables | None:
    """The model of a large ``text`` column, in shards; none if it has no more than ``least`` n-grams.

    Trigrams go, packed, to the shard of their context, which sums up the context and packs them by the round that their last
    two words belong to. Round by round they go on to the shards of these, which count the bigrams; what they ask about
    single words is joined by word.
    """
    spark, scratch = texts.sparkSession, Scratch(texts.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, fine = ((max(2, partitions * more) - 1).bit_length() for more in (1, ROUNDS))
    counted = (
        _block_trigrams(texts, bits, number, COUNT_ROUNDS).groupBy("shard").applyInArrow(lambda rows: _context_shard(rows, bits), _COUNTED)
        for number in range(COUNT_ROUNDS)
    )
    tri = scratch.store_rounds("trigrams", counted, "share")
    parts = "share long, shard long, word long, c long, sum long, n1 long, n2 long, n3 long, n4 long, more long"
    rounds = (_by_last_words(tri.where(F.col("share") == number), bits).groupBy("shard").applyInArrow(_word_parts, parts) for number in range(ROUNDS))
    parts = scratch.store_rounds("word-parts", rounds, "share")
    names = ["c", "sum", "n1", "n2", "n3", "n4", "more"]
    words = scratch.store("word-counts", parts.groupBy("word").agg(*[F.sum(name).alias(name) for name in names]))
    uni = words.where("c > 0").select("c")
    sums = words.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names], F.count(F.lit(1)).alias("words")).first()
    tri_sums = tri.agg(F.sum(F.when(F.col("codes").isNotNull(), F.col("n"))), *[F.sum(f"t{i}") for i in (1, 2, 3, 4)]).first()
    if (tri_sums[0] or 0) + sums["c"] + sums["words"] <= least:
        scratch.drop()
        return None
    d1, d2, d3 = _discounts(uni), _discounts_of({i: sums[f"n{i}"] for i in (1, 2, 3, 4)}), _discounts_of(dict(enumerate(tri_sums[1:], 1)))
    size, held = uni.agg(F.count(F.lit(1)), F.sum(_discount(d1))).first()
    total, held = sums["c"] or 1, held or 1.0
    unknown = held / total / (size + 1)
    p = F.when(F.col("c") > 0, (F.col("c") - _discount(d1)) / total + unknown)
    back = F.when(F.col("sum") > 0, (d2[0] * F.col("n1") + d2[1] * F.col("n2") + d2[2] * (F.col("n3") + F.col("n4") + F.col("more"))) / F.col("sum"))
    words = words.select("word", p.alias("p"), back.alias("back"), "sum")
    schema = "shard long, n long, keys binary, ends binary, follows binary"

    def weigh(rows: pa.Table, known: pa.Table) -> pa.Table:
        return _weigh(rows, known, d2, d3, fine)

    def shards() -> Iterator[DataFrame]:
        for number in range(ROUNDS):
            known = parts.where(F.col("share") == number).select("shard", "word").join(words, "word")
            found = _by_last_words(tri.where(F.col("share") == number), bits)
            yield found.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(weigh, schema)
            scratch.drop_part("trigrams", number)
            scratch.drop_part("word-parts", number)
        zero = F.lit(0.0)
        ends, follows = F.coalesce(F.ln("p") - math.log(unknown), zero), F.coalesce(F.ln("back"), zero)
        one = words.select(F.xxhash64("word").alias("key"), ends.cast("float").alias("ends"), follows.cast("float").alias("follows"))
        one = one.withColumn("shard", F.shiftright("key", 64 - fine))
        yield one.groupBy("shard").applyInArrow(lambda rows: _packed_weights(*(rows.column(name).to_numpy() for name in ("key", "ends", "follows")), fine), schema)

    weights = scratch.store_rounds("weights", shards())
    scratch.drop("trigrams", "word-parts", "word-counts")
    return Tables(weights, fine, unknown, scratch)


def _distinct(contexts: np.ndarray, last: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct contexts; of each distinct trigram the place of its context, its last word (of ``n``) and its count."""
    contexts, at = np.unique(contexts, return_inverse=True)
    if times is None:
        found, times = np.unique(at * n + last, return_counts=True)
    else:
        found, inverse = np.unique(at * n + last, return_inverse=True)
        times = np.bincount(inverse, times).astype(np.int64)
    return contexts, found // n, found % n, times


def _runs(sorted_shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    shards, begins = np.unique(sorted_shards, return_index=True)
    for shard, first, last in zip(shards.tolist(), begins, [*begins[1:], len(sorted_shards)]):
        yield shard, slice(first, last)


def _packed_trigrams(shards: np.ndarray, words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
    """Rows of ``_TRIGRAMS``, one for each shard, of three rows of places of words and some rows of counts."""
    order = np.argsort(shards, kind="stable")
    codes, counts = codes[:, order], counts[:, order]
    for shard, run in _runs(shards[order]):
        used, at = np.unique(codes[:, run], return_inverse=True)
        yield {
            "shard": shard,
            "n": run.stop - run.start,
            "v": len(used),
            "words": _pack(np.diff(words[used], prepend=np.int64(0))),
            "codes": _pack(at.astype(np.int32).ravel()),
            "counts": _pack(counts[:, run].ravel()),
        }


def _opened(rows: list[dict], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, three rows of places among them, and ``kinds`` rows of counts, of packed trigrams."""
    own = [np.cumsum(_unpacked(row["words"], row["v"])) for row in rows]
    words = np.unique(np.concatenate(own))
    codes = [np.searchsorted(words, known)[_unpacked(row["codes"], 3 * row["n"], np.int32)].reshape(3, -1) for row, known in zip(rows, own)]
    counts = [_unpacked(row["counts"], kinds * row["n"]).reshape(kinds, -1) for row in rows]
    return words, np.concatenate(codes, axis=1), np.concatenate(counts, axis=1)


def _block_trigrams(texts: DataFrame, bits: int, number: int, rounds: int) -> DataFrame:
    """The counted trigrams of blocks of texts, padded in front, packed by the shard of their context; each round has a share of the shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                hashes, codes, bounds = _word_codes(block)
                if not len(codes):
                    continue
                order = np.argsort(hashes)
                words, place = np.append(_PAD, hashes[order]), np.empty(len(order), np.int64)
                place[order] = np.arange(1, len(order) + 1)
                codes, n = place[codes], len(words)
                first, second = _history(codes, bounds, 2, 0), _history(codes, bounds, 1, 0)
                mine = (_keys(words[first], words[second]) >> (64 - bits)) % rounds == number
                contexts, at, last, times = _distinct((first * n + second)[mine], codes[mine], n)
                first, second = contexts // n, contexts % n
                shards = _keys(words[first], words[second]) >> (64 - bits)
                rows = _packed_trigrams(shards[at], words, np.stack([first[at], second[at], last]), times[None, :])
                yield pa.RecordBatch.from_pylist([*rows], _arrow(_TRIGRAMS))
        release_memory()

    return texts.select("text").mapInArrow(count, _TRIGRAMS)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _by_last_words(counted: DataFrame, bits: int) -> DataFrame:
    """Counted trigrams packed by the shard of their last two words; rows of contexts have one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                packed = [row]
                if row["codes"] is not None:
                    words, codes, counts = _opened([row], 4)
                    pairs, which = np.unique(codes[1] * len(words) + codes[2], return_inverse=True)
                    shards = _keys(words[pairs // len(words)], words[pairs % len(words)]) >> (64 - bits)
                    packed = [*_packed_trigrams(shards[which], words, codes, counts)]
                yield pa.RecordBatch.from_pylist(packed, _arrow(_TRIGRAMS))
        release_memory()

    return counted.select("shard", "n", "v", "words", "codes", "counts").mapInArrow(pack, _TRIGRAMS)


def _context_shard(rows: pa.Table, bits: int) -> pa.Table:
    """The trigrams of a shard of contexts, each with its count and how many its context has of count 1, 2 and more,
    packed by the share of the last two words; and a row of the contexts themselves, without ``codes``."""
    words, (first, second, last), (times,) = _opened(rows.to_pylist(), 1)
    n = len(words)
    contexts, at, last, times = _distinct(first * n + second, last, n, times)
    first, second = contexts // n, contexts % n
    kinds = np.stack([np.bincount(at, np.minimum(times, 3) == i, len(contexts)) for i in (1, 2, 3)]).astype(np.int64)
    keys = _keys(words[first], words[second])
    order, total = np.argsort(keys), np.bincount(at, times).astype(np.int64)
    shard = int(keys[0] >> (64 - bits))
    of_contexts = {
        "share": shard % ROUNDS,
        "shard": shard,
        "n": len(keys),
        "words": _pack(np.diff(keys[order], prepend=np.int64(0))),
        "counts": _pack(np.concatenate([total[None, :], kinds])[:, order].ravel()),
        **{f"t{i}": int((times == i).sum()) for i in (1, 2, 3, 4)},
    }
    pairs, which = np.unique(second[at] * n + last, return_inverse=True)
    shares = (_keys(words[pairs // n], words[pairs % n]) >> (64 - bits)) % ROUNDS
    packed = _packed_trigrams(shares[which], words, np.stack([first[at], second[at], last]), np.concatenate([times[None, :], kinds[:, at]]))
    return pa.Table.from_pylist([of_contexts, *[{**row, "share": row["shard"], "shard": None} for row in packed]], _arrow(_COUNTED))


def _bigrams(words: np.ndarray, second: np.ndarray, last: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last word and count of the bigrams that end trigrams, and the place of each trigram's."""
    n = len(words)
    pairs, which = np.unique(second * n + last, return_inverse=True)
    first = pairs // n
    # A lower order counts the different words before an n-gram; nothing stands before padding.
    counts = np.where(words[first] == _PAD, np.bincount(which, times), np.bincount(which)).astype(np.int64)
    return first, pairs % n, counts, which


def _word_parts(rows: pa.Table) -> pa.Table:
    """What the bigrams of a shard add to the counts of their last words, and of their first words as contexts."""
    shard, trigrams = rows.column("shard")[0].as_py(), [row for row in rows.to_pylist() if row["codes"] is not None]
    names = ["share", "shard", "word", "c", "sum", "n1", "n2", "n3", "n4", "more"]
    if not trigrams:
        return pa.table([pa.array([], pa.int64())] * len(names), names)
    words, (_, second, last), (times, *_) = _opened(trigrams, 4)
    first, last, counts, _ = _bigrams(words, second, last, times)
    ends, kinds = np.bincount(last, minlength=len(words)), np.minimum(counts, 5)
    parts = [ends, np.bincount(first, counts, len(words)), *[np.bincount(first, kinds == i, len(words)) for i in range(1, 6)]]
    some = (parts[0] > 0) | (parts[1] > 0)
    columns = [np.full(some.sum(), shard % ROUNDS), np.full(some.sum(), shard), words[some], *[part[some].astype(np.int64) for part in parts]]
    return pa.table([pa.array(column, pa.int64()) for column in columns], names)


def _weigh(rows: pa.Table, known: pa.Table, d2: list[float], d3: list[float], bits: int) -> pa.Table:
    """The packed weights of the trigrams and bigrams of a shard, and of the contexts in it."""
    rows = rows.to_pylist()
    trigrams, contexts = ([row for row in rows if (row["codes"] is None) == none] for none in (False, True))
    none = np.zeros(0, np.int64)
    two, two_ends, three, three_ends, context, follows = none, none, none, none, none, none
    if trigrams:
        words, (first, second, last), (times, n1, n2, n3) = _opened(trigrams, 4)
        three = _keys(words[first], words[second], words[last])
        first, last, counts, which = _bigrams(words, second, last, times)
        two = _keys(words[first], words[last])
        order = np.argsort(known.column("word").to_numpy())
        at = np.minimum(np.searchsorted(known.column("word").to_numpy()[order], words), len(order) - 1)
        p, back, total = (known.column(name).to_numpy(zero_copy_only=False)[order][at] for name in ("p", "back", "sum"))
        lower = back[first] * p[last]
        pair_p = (counts - np.array(d2)[np.minimum(counts, 3) - 1]) / total[first] + lower
        two_ends = np.log(pair_p) - np.log(lower)
        left = d3[0] * n1 + d3[1] * n2 + d3[2] * n3
        three_ends = np.log1p((times - np.array(d3)[np.minimum(times, 3) - 1]) / (left * pair_p[which]))
    if contexts:
        context = np.concatenate([np.cumsum(_unpacked(row["words"], row["n"])) for row in contexts])
        total, n1, n2, n3 = np.concatenate([_unpacked(row["counts"], 4 * row["n"]).reshape(4, -1) for row in contexts], axis=1)
        follows = np.log((d3[0] * n1 + d3[1] * n2 + d3[2] * n3) / total)
    both = np.unique(np.concatenate([two, context]))
    keys = np.concatenate([both, three])
    ends, after = np.zeros(len(keys)), np.zeros(len(keys))
    ends[np.searchsorted(both, two)], after[np.searchsorted(both, context)] = two_ends, follows
    ends[len(both) :] = three_ends
    return _packed_weights(keys, ends, after, bits)


def _packed_weights(keys: np.ndarray, ends: np.ndarray, follows: np.ndarray, bits: int) -> pa.Table:
    """``(shard, n, keys, ends, follows)``: weights packed by shard, which are a key's first bits."""
    order = np.argsort(keys)
    keys, ends, follows = keys[order], ends[order].astype("f4"), follows[order].astype("f4")
    rows = [
        (shard, run.stop - run.start, _pack(np.diff(keys[run], prepend=np.int64(0))), _pack(ends[run]), _pack(follows[run]))
        for shard, run in _runs(keys >> (64 - bits))
    ]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = [*zip(*rows)] or [[]] * len(kinds)
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["shard", "n", "keys", "ends", "follows"])


def _columns(table: DataFrame, keys: list[str], logs: list[str], empty: dict[str, float]) -> list[np.ndarray]:
    """Key columns as longs and logarithms as 32-bit floats, through Arrow."""
    logged = [F.ln(F.coalesce(name, F.lit(empty.get(name, 1.0)))).cast("float").alias(name) for name in logs]
    found = table.select(*keys, *logged).toArrow()
    return [found.column(name).to_numpy() for name in (*keys, *logs)]


def _in_memory(tables: _Stored) -> Model:
    words, pairs, triples, unknown = tables.words, tables.pairs, tables.triples, tables.unknown
    hashes, word_p, word_back = _columns(words, ["w3"], ["p", "back"], {"p": unknown})
    is_pad = hashes == _PAD
    pad_back = word_back[is_pad][:1] if is_pad.any() else np.zeros(1, "f4")
    order = np.argsort(hashes[~is_pad])
    hashes, word_p, word_back = (column[~is_pad][order] for column in (hashes, word_p, word_back))
    n = len(hashes)

    def places(values: np.ndarray) -> np.ndarray:
        return np.where(values == _PAD, n, np.searchsorted(hashes, values))

    first, second, pair_p, pair_back = _columns(pairs, ["a", "b"], ["p", "back"], {"p": unknown})
    pair_key = places(first) * (n + 2) + places(second)
    order = np.argsort(pair_key)
    pair_key, pair_p, pair_back = pair_key[order], pair_p[order], pair_back[order]
    first, second, third, triple_p = _columns(triples, ["w1", "w2", "w3"], ["p"], {})
    context = np.searchsorted(pair_key, places(first) * (n + 2) + places(second))
    triple_key = context * (n + 2) + places(third)
    order = np.argsort(triple_key)
    floor = np.float32(math.log(unknown))
    return Model(
        hashes,
        np.append(word_p, [floor, floor]).astype("f4"),
        np.append(word_back, [pad_back[0], 0]).astype("f4"),
        pair_key,
        pair_p,
        pair_back,
        triple_key[order],
        triple_p[order],
    )


def with_scores(docs: DataFrame, model: Model | Broadcast) -> DataFrame:
    """``docs`` with ``_tl_n`` words and ``_tl_log_p``, the natural log probability of whole texts.

    A model that scores several tables is broadcast once and given as such, so workers hold it once.
    """
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            counts, sums = [], []
            for block in text_blocks(batch.column(text)):
                p, bounds = tables.log_probabilities(block)
                ends = np.concatenate([[0.0], np.cumsum(p, dtype="f8")])
                counts.append(np.diff(bounds))
                sums.append(ends[bounds[1:]] - ends[bounds[:-1]])
            if counts:
                added = [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(sums), pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "_tl_n", "_tl_log_p"])
        release_memory()

    schema = StructType([*docs.schema, StructField("_tl_n", LongType()), StructField("_tl_log_p", DoubleType())])
    return docs.mapInArrow(score, schema)


def perplexity() -> Column:
    return F.when(F.col("_tl_n") > 0, F.exp(-F.col("_tl_log_p") / F.col("_tl_n")))


def _asked(texts: DataFrame, bits: int, number: int = 0, rounds: int = 1) -> DataFrame:
    """The words, bigrams and trigrams of texts ``(slot, text)`` that look up a weight, one row per block of texts and shard.

    ``keys`` are ascending, ``places`` tell which text of the block an n-gram is of, ``times`` how often it ends with a word
    of the text, times 2**32, plus how often it is the context of the next one. ``slots`` stand in the first row of a block.
    A key's shard are its first ``bits`` bits; of the shards each round has others. All are packed, as every n-gram of the
    corpus is shuffled.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for block in text_blocks(batch.column(1)):
                slots = batch.column(0).slice(first, len(block)).to_numpy()
                first += len(block)
                hashes, codes, bounds = _word_codes(block)
                if len(codes):
                    ngrams = _ngrams(hashes, codes, bounds, lambda keys: (keys >> (64 - bits)) % rounds == number)
                    if len(ngrams[0]):
                        yield _packed_block(slots, *ngrams, bits)
        release_memory()

    schema = "shard long, block long, n long, keys binary, places binary, times binary, slots binary"
    return texts.select("slot", "text").mapInArrow(found, schema)


def _ngrams(
    hashes: np.ndarray, codes: np.ndarray, bounds: np.ndarray, asked: Callable[[np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places and times of the n-grams of a block whose keys are asked for."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    some = np.diff(bounds) > 0
    goes_on = np.ones(len(codes), np.int64)
    goes_on[bounds[1:][some] - 1] = 0
    one, zero = _keys(hashes), np.zeros(1, np.int64)
    pad, pads = _keys(zero), _keys(zero, zero)
    # Of a text's words each once, and the padding in front of it as contexts.
    mine = asked(one)[codes]
    distinct, inverse = np.unique(owner[mine] * len(hashes) + codes[mine], return_inverse=True)
    ends, follows = np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse, goes_on[mine], len(distinct)).astype(np.int64)
    found = [(one[distinct % len(hashes)], distinct // len(hashes), (ends << 32) + follows)]
    for key in (pad, pads):
        begun = owner[bounds[:-1][some]] if asked(key)[0] else owner[:0]
        found.append((np.full(len(begun), key[0]), begun, np.ones(len(begun), np.int64)))
    # The hash of a longer n-gram goes on from that of its context.
    mixed = _mixed(hashes)[codes]
    two = _stirred(_history(one[codes], bounds, 1, pad[0]), mixed)
    mine = asked(two)
    found.append((two[mine], owner[mine], (1 << 32) + goes_on[mine]))
    three = _stirred(_history(two, bounds, 1, pads[0]), mixed)
    mine = asked(three)
    found.append((three[mine], owner[mine], np.full(mine.sum(), 1 << 32)))
    keys, places, times = (np.concatenate(column) for column in zip(*found))
    return keys, places, times


def _packed_block(slots: np.ndarray, keys: np.ndarray, places: np.ndarray, times: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, places, times = keys[order], places[order], times[order]
    # Told by its texts, a block has the same number in a task that is run again; blocks of the same texts add up.
    block = np.uint64(xxhash.xxh64_intdigest(slots.tobytes())).view(np.int64)
    shards, rows = zip(*_runs(keys >> (64 - bits)))
    columns = [
        pa.array(shards, pa.int64()),
        pa.array(np.full(len(rows), block), pa.int64()),
        pa.array([row.stop - row.start for row in rows], pa.int64()),
        pa.array([_pack(np.diff(keys[row], prepend=np.int64(0))) for row in rows], pa.binary()),
        pa.array([_pack(places[row]) for row in rows], pa.binary()),
        pa.array([_pack(times[row]) for row in rows], pa.binary()),
        pa.array([slots.tobytes(), *[None] * (len(rows) - 1)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "block", "n", "keys", "places", "times", "slots"])


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, compressed with first all their first bytes, then all second ones and so on."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_ONE, _TWO, _THREE, _FOUR, _FIVE = (
    np.uint64(prime)
    for prime in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(words: np.ndarray) -> np.ndarray:
    return _turned(words.view(np.uint64) * _TWO, 31) * _ONE


def _stirred(keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The keys of n-grams by those of their contexts and by their last words, ``_mixed``."""
    key = (keys.view(np.uint64) + (_FIVE + np.uint64(8))) ^ mixed
    key = _turned(key, 27) * _ONE + _FOUR
    key = (key ^ (key >> np.uint64(33))) * _TWO
    key = (key ^ (key >> np.uint64(29))) * _THREE
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _keys(*words: np.ndarray) -> np.ndarray:
    """``_key`` of word hashes: Spark's ``xxhash64`` of longs."""
    key = np.full(len(words[0]), 42, np.int64)
    for word in words:
        key = _stirred(key, _mixed(word))
    return key


def _shard_sums(asked: pa.Table, weights: pa.Table) -> pa.Table:
    """``(block, n, places, sums, slots)``: what the n-grams of a shard add to each text of each block."""
    packed = weights.select(["n", "keys", "ends", "follows"]).to_pylist()
    known = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_unpacked(row["keys"], row["n"])) for row in packed]])
    order = np.argsort(known)
    known = known[order]
    ends, follows = (
        np.concatenate([np.zeros(0), *[_unpacked(row[name], row["n"], np.float32) for row in packed]])[order] for name in ("ends", "follows")
    )
    rows = []
    for row in asked.select(["block", "n", "keys", "places", "times", "slots"]).to_batches(64):
        for block, n, keys, places, times, slots in zip(*(column.to_pylist() for column in row.columns)):
            at, has = Model._find(known, np.cumsum(_unpacked(keys, n)))
            at, times, places = at[has], _unpacked(times, n)[has], _unpacked(places, n)[has]
            texts, inverse = np.unique(places, return_inverse=True)
            sums = np.bincount(inverse, (times >> 32) * ends[at] + (times & (1 << 32) - 1) * follows[at], len(texts))
            if len(texts) or slots is not None:
                rows.append((block, len(texts), _pack(texts), _pack(sums), slots))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = [*zip(*rows)] or [[]] * len(kinds)
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["block", "n", "places", "sums", "slots"])


def _block_sums(table: pa.Table) -> pa.Table:
    """``(slot, known)`` of the texts of a block."""
    rows = table.select(["n", "places", "sums", "slots"]).to_pylist()
    slots = np.frombuffer(next(row["slots"] for row in rows if row["slots"] is not None), np.int64)
    sums = np.zeros(len(slots))
    for row in rows:
        sums[_unpacked(row["places"], row["n"])] += _unpacked(row["sums"], row["n"], np.float64)
    return pa.table({"slot": slots, "known": sums})


def _known_parts(texts: DataFrame, model: Tables) -> DataFrame:
    """``(slot, known)``: the sum of the weights of a text's n-grams; texts are joined to the weights shard by shard."""
    rounds = (
        _asked(texts, model.bits, number, ROUNDS)
        .groupBy("shard")
        .cogroup(model.weights.where(F.pmod("shard", F.lit(ROUNDS)) == number).groupBy("shard"))
        .applyInArrow(_shard_sums, "block long, n long, places binary, sums binary, slots binary")
        .groupBy("block")
        .applyInArrow(_block_sums, "slot long, known double")
        for number in range(ROUNDS)
    )
    known = Scratch(texts.sparkSession).store_rounds("known-parts", rounds)
    return known.groupBy("slot").agg(F.sum("known").alias("known"))


def _key(*words: str | Column) -> Column:
    """An n-gram's hash; null words, in front, are left out."""
    return F.xxhash64(*words).alias("key")


def _counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, slot, _tl_n)`` of every row, stored; ``slot`` is a hash of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.diff(_words(block)[1]) for block in text_blocks(batch.column(3))]
            if numbers:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(np.concatenate(numbers), pa.int64())], ["doc_id", "lang", "slot", "_tl_n"]
                )

    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("slot"), "text")
    schema = StructType([*rows.schema.fields[:3], StructField("_tl_n", LongType())])
    return materialise(rows.mapInArrow(count, schema), "counted-texts")


def _joined_scores(docs: DataFrame, model: Tables) -> DataFrame:
    """``(doc_id, lang, slot, _tl_n, _tl_perplexity)`` of every row, stored; n-grams are joined to the model's.

    Copies of a text add up in one slot, their words as their logarithms.
    """
    rows = _counted(docs)
    known = _known_parts(docs.select(F.xxhash64("text").alias("slot"), "text"), model)
    words = rows.groupBy("slot").agg(F.sum("_tl_n").alias("words"))
    mean = F.coalesce("known", F.lit(0.0)) / F.col("words") + math.log(model.unknown)
    scored = words.where("words > 0").join(known, "slot", "left").select("slot", F.exp(-mean).alias("_tl_perplexity"))
    scored = materialise(scored, "text-perplexities")
    return materialise(rows.join(scored, "slot", "left").select("doc_id", "lang", "slot", "_tl_n", "_tl_perplexity"), "scores")


def scores(docs: DataFrame, model: Model | Broadcast | Tables) -> DataFrame:
    """``(doc_id, lang, _tl_n, _tl_perplexity)`` of every row, stored; texts are not moved."""
    if isinstance(model, Tables):
        return _joined_scores(docs, model).drop("slot")
    scored = with_scores(docs.select(docs["doc_id"], docs["lang"], docs["text"]), model)
    return materialise(scored.select("doc_id", "lang", "_tl_n", perplexity().alias("_tl_perplexity")), "scores")


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where(labels["quality"] == 1).select(labels["doc_id"].alias("_tl_id")).distinct()


def _held_out(known: DataFrame) -> DataFrame:
    """``known`` with ``_tl_held``: whether a trusted document is kept for the thresholds.

    One hash fold in ``HELD_FOLDS``. In every language the document of ``MIN_WORDS`` words or more
    with the smallest hash is held out as well, and the one with the largest hash is not, unless it
    is the only one.
    """
    hashed = known.withColumn("_tl_hash", F.xxhash64(F.lit("held"), "_tl_id"))
    key = F.struct("_tl_hash", "_tl_id")
    per_language = hashed.where("_tl_long").groupBy("_tl_lang")
    ends = per_language.agg(F.min(key)["_tl_id"].alias("first"), F.max(key)["_tl_id"].alias("last"))
    ends = materialise(ends, "ends")
    first = ends.select(F.col("first").alias("_tl_end"), F.lit(True).alias("_tl_first"))
    last = ends.where("first != last").select(F.col("last").alias("_tl_end"), F.lit(False).alias("_tl_first"))
    fixed = first.unionByName(last).groupBy("_tl_end").agg(F.max("_tl_first").alias("_tl_first"))
    in_fold = F.pmod("_tl_hash", F.lit(HELD_FOLDS)) == 0
    joined = hashed.join(fixed, F.col("_tl_id") == F.col("_tl_end"), "left")
    return joined.withColumn("_tl_held", F.coalesce("_tl_first", in_fold)).select(*known.columns, "_tl_held")


def train(
    docs: DataFrame, labels: DataFrame, train_docs: int | None = None, broadcast_ngrams: int = BROADCAST_NGRAMS
) -> tuple[Model | Tables, DataFrame]:
    """A model of trusted documents (``quality`` 1 in ``labels``), and the ids it was fitted on.

    These are all trusted documents, of any length, that are not held out for the thresholds;
    with ``train_docs`` only so many, those with the smallest hash of ``doc_id``. A model of more than
    ``broadcast_ngrams`` n-grams is returned as tables.
    """
    trusted = _trusted(labels)
    facts = docs.select(
        docs["doc_id"].alias("_tl_doc"), docs["lang"].alias("_tl_lang"), docs["text"].rlike(_JUDGED).alias("_tl_long")
    )
    known = materialise(trusted.join(facts, F.col("_tl_id") == F.col("_tl_doc")).drop("_tl_doc"), "trusted")
    sample = (
        _held_out(known)
        .groupBy("_tl_id")
        .agg(F.max("_tl_held").alias("_tl_held"))
        .where(~F.col("_tl_held"))
        .select("_tl_id")
    )
    if train_docs is not None:
        sample = sample.orderBy(F.xxhash64("_tl_id"), "_tl_id").limit(train_docs)
    sample = materialise(sample, "sample")
    ids = F.broadcast(sample) if sample.count() <= BROADCAST_IDS else sample
    texts = docs.join(ids, docs["doc_id"] == sample["_tl_id"], "left_semi").select(docs["text"])
    # Each word ends three n-grams, so few words make a small model.
    tables = fit_tables(texts, broadcast_ngrams) if 3 * _n_words(texts) > broadcast_ngrams else None
    return tables or fit(texts), sample


def thresholds(
    scored: DataFrame, labels: DataFrame, sample: DataFrame, quantile: float = QUANTILE, slack: float = SLACK
) -> tuple[DataFrame, float | None]:
    """``(_tl_lang, _tl_limit)`` per language, and one limit over all.

    A limit is the ``quantile`` of the perplexities of all trusted documents outside the sample,
    times ``slack``. Those of less than ``MIN_WORDS`` words, whose perplexity never rejects, set
    none. Every language with longer trusted documents has some of them outside; with fewer than
    ``LEAST_HELD`` it takes the overall limit if that is larger, since so few documents say little
    about a high quantile. A language without any takes the overall limit; without trusted documents
    there is none, and nothing is rejected for its perplexity.
    """
    unseen = _trusted(labels).join(sample.withColumnRenamed("_tl_id", "_tl_seen"), F.col("_tl_id") == F.col("_tl_seen"), "left_anti")
    judged = scored.where(F.col("_tl_n") >= MIN_WORDS).join(unseen, scored["doc_id"] == F.col("_tl_id"), "left_semi")
    limit = F.percentile_approx("_tl_perplexity", quantile, 100_000) * slack
    overall = judged.agg(limit).first()[0]
    own = judged.groupBy(F.col("lang").alias("_tl_lang")).agg(limit.alias("own"), F.count(F.lit(1)).alias("n"))
    per_language = own.select(
        "_tl_lang",
        F.when(F.col("n") >= LEAST_HELD, F.col("own"))
        .otherwise(F.greatest("own", F.lit(overall).cast("double")))
        .alias("_tl_limit"),
    )
    return materialise(per_language, "thresholds"), overall


def _judged(scored: DataFrame, limits: DataFrame, overall: float | None) -> DataFrame:
    """``scored`` with ``_tl_limit`` and ``_tl_kept``."""
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["_tl_lang"]), "left")
    limit = F.coalesce("_tl_limit", F.lit(overall).cast("double"))
    fits = limit.isNull() | (F.col("_tl_perplexity") <= limit) | (F.col("_tl_n") < MIN_WORDS)
    kept = F.coalesce((F.col("_tl_n") > 0) & fits, F.lit(False))
    return joined.withColumn("_tl_kept", kept).withColumn("_tl_limit", limit)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, **options) -> DataFrame:
    """``(doc_id, lang, n_words, perplexity, threshold, kept)`` of every row of ``docs``.

    Null, empty and blank texts have no perplexity and are rejected. Texts of one to ``MIN_WORDS``
    words say too little to be rejected by their perplexity. Repeated rows are judged one by
    one, alike. An empty table stays empty.
    """
    model, sample = train(docs, labels, **options)
    scored = scores(docs, model)
    if isinstance(model, Tables):
        model.scratch.drop()
    return _judged(scored, *thresholds(scored, labels, sample, quantile, slack)).select(
        "doc_id",
        "lang",
        F.col("_tl_n").alias("n_words"),
        F.col("_tl_perplexity").alias("perplexity"),
        F.col("_tl_limit").alias("threshold"),
        F.col("_tl_kept").alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, **options
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns (none may start with ``_tl_``).

    With a model in memory texts are scored twice, for the thresholds and to filter, so they are
    not shuffled; else they are joined to the hashes of those to keep.
    """
    model, sample = train(docs, labels, **options)
    if isinstance(model, Tables):
        scored = _joined_scores(docs, model)
        model.scratch.drop()
        judged = _judged(scored, *thresholds(scored, labels, sample, quantile, slack)).where("_tl_kept")
        kept = materialise(judged.select(F.col("slot").alias("_tl_slot"), F.col("lang").alias("_tl_of")).distinct(), "kept-texts")
        same = (F.xxhash64(docs["text"]) == F.col("_tl_slot")) & docs["lang"].eqNullSafe(F.col("_tl_of"))
        return docs.join(kept, same, "left_semi").select(*docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(model)
    limits = thresholds(scores(docs, model), labels, sample, quantile, slack)
    scored = with_scores(docs, model).withColumn("_tl_perplexity", perplexity())
    return _judged(scored, *limits).where("_tl_kept").select(*docs.columns)
