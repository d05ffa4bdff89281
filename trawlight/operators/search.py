"""Ranked results: top hits of one search, and of a whole table of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlight.functions.text import tokens
from trawlight.operators.index import Index, corpus_stats, ranged
from trawlight.operators.match import inverse_frequency, saturated, total
from trawlight.schemas import SEARCH_HIT
from trawlight.session import materialise
from trawlight.sources.ranges import RANGE, RangedTable, ranges_in

DEFAULT_LIMIT = 10
_HIT_COLUMNS = [name for name in SEARCH_HIT.names if name != "rank"]


def ranked(matches: DataFrame) -> DataFrame:
    """Rank is the negated score: lower is better."""
    return matches.select("doc_id", (-F.col("score")).alias("rank"))


def top_matches(matches: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best ``limit`` documents, ties by insert sequence; a negative limit keeps all."""
    ordered = ranked(matches).orderBy("rank", "doc_id")
    return ordered if limit < 0 else ordered.limit(limit)


def search(matches: DataFrame, documents: DataFrame | RangedTable, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Search hits without the body, best first.

    Documents are joined only after the cut, so the wide columns are read for the hits alone. Of a stored
    table only the ranges of the hits are opened; with a limit, no more numbers reach the driver.
    """
    top = top_matches(matches, limit)
    if isinstance(documents, RangedTable):
        if limit >= 0:
            top = materialise(top, "hits")
            documents = documents.of_ranges(ranges_in(top, "doc_id", documents.range_rows))
        else:
            documents = documents.rows
    wide = documents.select(F.col("ingest_seq").alias("doc_id"), *_HIT_COLUMNS)
    return top.join(wide, "doc_id").orderBy("rank", "doc_id").select(*_HIT_COLUMNS, "rank")


def search_batch(queries: DataFrame, index: Index, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``(query_id, doc_id, rank, position)``: best documents holding all tokens of each query.

    Documents are searched range by range. The dictionary bounds what a range can give a query: each
    term as often as it stands in any document there, in the shortest one. The range of the highest
    bound is searched first; others are opened only if their bound reaches the k-th score found so far, and a
    range that lacks a term never is. Inside a range each query starts from its rarest term, which bounds the
    candidates; the other terms are looked up by (term, document).
    """
    index = ranged(index)
    tokenised = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    counted = tokenised.groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    # Stored, so that the planner knows its size and broadcasts it to the index if it is small.
    wanted = materialise(counted, "query-terms")
    words = materialise(wanted.select("term").distinct(), "query-words")
    held = index.terms.join(words, "term", "left_semi")
    held = materialise(held, "query-dictionary")
    postings = index.postings
    if index.buckets:
        # At most one number per bucket; the folders without a wanted term are not listed at all.
        used = [row[0] for row in held.select("term_bucket").distinct().collect()]
        postings = postings.where(F.col("term_bucket").isin(used))

    stats = corpus_stats(index)
    documents, average = stats.select("documents").scalar(), stats.select("average_length").scalar()
    frequencies = held.groupBy("term").agg(F.sum("df").alias("df"))
    weighed = wanted.join(frequencies, "term").withColumn("gain", F.col("weight") * inverse_frequency(documents, F.col("df")))
    asked = wanted.groupBy("query_id").agg(F.count("*").alias("terms"))
    weighed = materialise(weighed.join(asked, "query_id"), "query-gains")
    rarest = weighed.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("_rarest")).select(
        "query_id", F.col("_rarest.term").alias("rarest")
    )
    most = saturated(F.col("most"), F.col("shortest"), average)
    bounds = (
        weighed.join(held.select("term", RANGE, "most", "shortest"), "term")
        .groupBy("query_id", RANGE)
        .agg(total(F.col("gain") * most).alias("bound"), F.count("*").alias("found"), F.max("terms").alias("terms"))
        .where("found = terms")
        .drop("found", "terms")
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), RANGE)
    bounds = bounds.withColumn("_place", F.row_number().over(best_first)).join(rarest, "query_id")
    bounds = materialise(bounds, "range-bounds")

    def matches(ranges: DataFrame) -> DataFrame:
        """``(query_id, doc_id, score)`` of all documents of some ``(query_id, seq_range, rarest)``."""
        # Only the lists of a range's queries are moved; stored, so that a small table of them is broadcast.
        needed = ranges.join(weighed.select("query_id", "term"), "query_id").select(RANGE, "term").distinct()
        needed = materialise(needed, "needed-lists")
        lists = postings.select(RANGE, "term", "doc_id", "tf", "dl").join(words, "term", "left_semi")
        lists = lists.join(needed, [RANGE, "term"], "left_semi")
        starts = ranges.select("query_id", RANGE, F.col("rarest").alias("term"))
        candidates = starts.join(lists.select(RANGE, "term", "doc_id"), [RANGE, "term"]).select("query_id", RANGE, "doc_id")
        looked_up = candidates.join(weighed.select("query_id", "term", "gain", "terms"), "query_id")
        found = looked_up.join(lists, [RANGE, "term", "doc_id"])
        return (
            found.groupBy("query_id", "doc_id")
            .agg(
                total(F.col("gain") * saturated(F.col("tf"), F.col("dl"), average)).alias("score"),
                F.count("*").alias("found"),
                F.max("terms").alias("terms"),
            )
            .where("found = terms")
            .select("query_id", "doc_id", "score")
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    if limit < 0:
        everything = matches(bounds)
    else:
        first = matches(bounds.where("_place = 1")).withColumn("_hit", F.row_number().over(best)).where(F.col("_hit") <= limit)
        first = materialise(first, "first-hits")
        enough = first.where(F.col("_hit") == limit).select("query_id", F.col("score").alias("_least"))
        # A sum that is rounded differently must not hide a tie.
        rest = bounds.where("_place > 1").join(enough, "query_id", "left").where(
            F.coalesce(F.col("bound") >= F.col("_least") * (1 - 1e-9) - 1e-9, F.lit(limit > 0))
        )
        everything = first.drop("_hit").unionByName(matches(rest))
    ranked_hits = everything.withColumn("position", F.row_number().over(best))
    if limit >= 0:
        ranked_hits = ranked_hits.where(F.col("position") <= limit)
    return ranked_hits.select("query_id", "doc_id", (-F.col("score")).alias("rank"), "position")
