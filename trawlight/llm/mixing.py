"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each document is repeated a Poisson-distributed number of times. The mean is its source's target
rate, ``size * weight / documents of the source``; the uniform number that is put into the inverse
distribution is a hash of seed and ``doc_id``, so a rerun or a retried task repeats the same
documents. Copies are then dealt out and ordered by a hash of document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlight.session import materialise

MAX_RATE = 10_000.0


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 bits from the MD5 of ``seed:doc_id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """``P(count <= k)`` for k = 0, 1, ... until nothing that a double can tell from 1 is left."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.ln(rate) - F.ln(k)
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(state["cdf"], total).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["cdf"])
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, size: float | None = None
) -> DataFrame:
    """``(source, rate)``: the mean number of copies of a document of each source.

    ``weights`` has one row ``(source, weight)`` per source; a source it lacks gets no copies, and a
    weight of an unknown source has no effect. Without it a source weighs its number of documents to
    the ``power``. ``size`` is the expected number of rows, by default that of ``docs``. A null
    source is a source of its own. Only counts per source are moved.
    """
    counts = docs.groupBy(docs["source"].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        wanted = weights.select(weights["source"].alias("wanted"), weights["weight"].cast("double").alias("weight"))
        weighted = counts.join(wanted, F.col("source").eqNullSafe(F.col("wanted")), "left").drop("wanted")
        weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rows, total = weighted.agg(F.sum("n"), F.sum("weight")).first()
    wanted_rows = float(size if size is not None else rows or 0)
    rate = F.lit(wanted_rows) * F.col("weight") / F.lit(float(total or 1.0)) / F.col("n")
    return weighted.select(
        "source", F.when(rate <= MAX_RATE, rate).otherwise(F.raise_error(F.lit("rate above MAX_RATE"))).alias("rate")
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, size: float | None = None, seed: int = 7
) -> DataFrame:
    """All columns of ``docs`` and ``_copy`` (from 0), each document as often as it was drawn.

    Rows with equal ``doc_id`` are drawn alike, null ids too; texts play no part, so null, empty and
    very long ones are drawn like any other. An empty table stays empty. A column of the input named
    ``_copy`` is kept as ``_copy_in``; names that start with ``_tl_`` are taken. A rate above ``MAX_RATE`` raises
    an error. A hot source costs nothing extra: the rates, a small table per source, are stored first, so
    the planner knows their size and leaves the documents where they are. Copies are dealt out by a hash
    of the whole row and the copy, so equal or missing ids do not meet in one task.
    """
    docs = docs.withColumnsRenamed({"_copy": "_copy_in"})
    rates = source_rates(docs, weights, power, size).select(
        F.col("source").alias("_tl_source"), poisson_cdf(F.col("rate")).alias("_tl_cdf")
    )
    rates = materialise(rates, "rates")
    drawn = docs.withColumn("_tl_u", uniform(docs["doc_id"], seed)).join(
        rates, F.col("source").eqNullSafe(F.col("_tl_source"))
    )
    count = F.size(F.filter("_tl_cdf", lambda total: total <= F.col("_tl_u")))
    hashed = [name for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    copies = (
        drawn.withColumn("_tl_count", count)
        .where(F.col("_tl_count") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_tl_count") - 1)))
        .withColumn("_tl_key", F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in hashed], "_copy"))
    )
    shuffled = copies.repartition("_tl_key").sortWithinPartitions("_tl_key")
    return shuffled.select(*[F.col(f"`{name}`") for name in docs.columns], "_copy")
