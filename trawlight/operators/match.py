"""Full-text matching as relations.

A match operator returns ``(doc_id, score)`` with one row per matching document. What a phrase
adds to the score depends only on its own occurrences in the document, so it is fixed where the
phrase is matched; the boolean operators then just join, add up or subtract such relations. That
gives a sub-expression which does not hold in a document no weight there, without further care.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlight.functions.text import query_tokens
from trawlight.operators.index import (
    COLUMN_STEP, DOCUMENT_TERM, Index, corpus_stats, document_frequency, posting_list, prefix_postings,
)
from trawlight.schemas import SEARCHABLE

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6


def inverse_frequency(documents: Column, df: Column) -> Column:
    """Weight of a phrase; one found in half the documents or more counts almost nothing."""
    idf = F.log((documents - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))


def saturated(tf: Column, dl: Column, average_length: Column) -> Column:
    """Share of a phrase weight that ``tf`` occurrences earn in a document of length ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average_length))


def total(scores: Column) -> Column:
    """Sum of scores that does not depend on the order of the rows, so that equal documents tie."""
    return F.sum(scores.cast("decimal(38,18)")).cast("double")


def _score(
    hits: DataFrame, index: Index, counted: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Score phrase hits ``(doc_id, dl, tf)``; ``counted`` are the rows that make up df, ``known`` has it.

    The three numbers of the corpus are scalar subqueries: no join, nothing on the driver.
    """
    stats = corpus_stats(index)
    df = known.select("df").scalar() if known is not None else (hits if counted is None else counted).agg(F.count("*")).scalar()
    idf = inverse_frequency(stats.select("documents").scalar(), df)
    gain = saturated(F.col("tf"), F.col("dl"), stats.select("average_length").scalar())
    return hits.select("doc_id", (idf * gain).alias("score"))


def _restrict(places: Column, columns: list[str] | None, excluded: list[str] | None, initial: bool) -> Column:
    """Keep the places in the wanted columns, and only column starts if ``initial``."""
    allowed = [SEARCHABLE.index(name) for name in (columns or SEARCHABLE) if name not in (excluded or [])]
    if len(allowed) < len(SEARCHABLE):
        numbers = F.array(*[F.lit(number).cast("bigint") for number in allowed])
        places = F.filter(places, lambda place: F.array_contains(numbers, F.floor(place / COLUMN_STEP)))
    if initial:
        places = F.filter(places, lambda place: place % COLUMN_STEP == 0)
    return places


def _term_places(index: Index, term: str) -> DataFrame:
    return posting_list(index, [term]).select("doc_id", "dl", "places")


def _term_frequency(index: Index, term: str) -> DataFrame:
    """Hits of an unrestricted term; the places are not read."""
    return posting_list(index, [term]).select("doc_id", "dl", "tf")


def _phrase_places(index: Index, terms: list[str]) -> DataFrame:
    """``(doc_id, dl, places)``: where the terms stand next to each other, in order."""
    if len(terms) == 1:
        return _term_places(index, terms[0])

    def follow(found: DataFrame, step: tuple[int, str]) -> DataFrame:
        offset, term = step
        next_term = _term_places(index, term).select("doc_id", F.col("places").alias("_next"))
        starts = F.transform("_next", lambda place: place - offset)
        return found.join(next_term, "doc_id").select(
            "doc_id", "dl", F.array_intersect("places", starts).alias("places")
        )

    return reduce(follow, enumerate(terms[1:], 1), _term_places(index, terms[0])).where(F.size("places") > 0)


def _nothing(index: Index) -> DataFrame:
    return _score(_term_frequency(index, DOCUMENT_TERM).limit(0), index)


def _counted(found: DataFrame, columns, excluded, initial) -> DataFrame:
    kept = found.withColumn("places", _restrict(F.col("places"), columns, excluded, initial))
    return kept.select("doc_id", "dl", F.size("places").alias("tf")).where(F.col("tf") > 0)


def match_term(
    index: Index,
    text: str,
    columns: list[str] | None = None,
    excluded: list[str] | None = None,
    initial: bool = False,
) -> DataFrame:
    """Documents that contain a term, or the tokens of ``text`` as a phrase.

    ``columns`` and ``excluded`` restrict the columns; ``initial`` asks for the start of a column.
    Both apply before occurrences and documents are counted.
    """
    terms = query_tokens(text)
    if not terms:
        return _nothing(index)
    if len(terms) == 1 and not (columns or excluded or initial):
        return _score(_term_frequency(index, terms[0]), index, known=document_frequency(index, terms[0]))
    return _score(_counted(_phrase_places(index, terms), columns, excluded, initial), index)


match_phrase = match_term


def match_prefix(
    index: Index,
    prefix: str,
    columns: list[str] | None = None,
    excluded: list[str] | None = None,
    initial: bool = False,
) -> DataFrame:
    """Documents with a term that starts with ``prefix``; all such terms are one phrase.

    Of several tokens the last is the prefix, and the others stand before it as a phrase. Without
    a token nothing matches. A stored index opens only the buckets of the terms that its dictionary finds.
    """
    tokens = query_tokens(prefix)
    if not tokens:
        return _nothing(index)
    *before, start = tokens
    wanted = prefix_postings(index, start)
    if not before:
        places = _restrict(F.col("places"), columns, excluded, initial)
        found = wanted.select("doc_id", "dl", F.size(places).alias("tf"))
        hits = found.where(F.col("tf") > 0).groupBy("doc_id").agg(F.max("dl").alias("dl"), F.sum("tf").alias("tf"))
        return _score(hits, index)
    starts = F.transform("places", lambda place: place - len(before))
    ends = wanted.select("doc_id", starts.alias("_starts"))
    # One array per document, no longer than its text.
    ends = ends.groupBy("doc_id").agg(F.flatten(F.collect_list("_starts")).alias("_starts"))
    phrase = _phrase_places(index, before).join(ends, "doc_id")
    found = phrase.select("doc_id", "dl", F.array_intersect("places", "_starts").alias("places"))
    return _score(_counted(found, columns, excluded, initial), index)


def _near_counts(both: DataFrame, widths: list[int]) -> DataFrame:
    """``(doc_id, dl, tf0, tf1, ...)``: occurrences of each phrase that stand in a window with all others.

    ``both`` has the places of phrase n in ``p<n>``. One sweep over all places in order finds the last
    starts that suit: those before which every phrase has a place at most its width away. A sweep
    backwards finds for each place the next such start. Both are sorted once and linear in the places.
    """
    def tag(number: int) -> Column:
        return F.transform(f"p{number}", lambda place: F.struct(place.alias("place"), F.lit(number).alias("phrase")))

    tagged = F.flatten(F.array(*[tag(number) for number in range(len(widths))]))
    places = both.select("doc_id", "dl", F.inline(tagged))
    own = Window.partitionBy("doc_id")
    up = own.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = own.orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.max(F.when(F.col("phrase") == n, F.col("place"))).over(up) for n in range(len(widths))]
    suits = reduce(
        Column.__and__, [F.coalesce(last >= F.col("place") - width, F.lit(False)) for last, width in zip(latest, widths)]
    )
    swept = places.withColumn("_last", F.when(suits, F.col("place"))).withColumn("_next", F.min("_last").over(down))
    return swept.groupBy("doc_id").agg(
        F.max("dl").alias("dl"),
        *[
            F.count_if((F.col("phrase") == n) & (F.col("_next") <= F.col("place") + width)).alias(f"tf{n}")
            for n, width in enumerate(widths)
        ],
    )


def match_near(
    index: Index,
    terms: list[str],
    distance: int = 10,
    columns: list[str] | None = None,
    excluded: list[str] | None = None,
) -> DataFrame:
    """Documents where all terms stand in one column with at most ``distance`` tokens between them.

    A term of several tokens is a phrase; one without a token is left out, and nothing matches when
    none is left. An occurrence counts when it fits into a window with occurrences of all others:
    none ends more than ``distance`` tokens before the start of the last one. df ignores the
    distance, but not the columns.
    """
    phrases = [tokens for tokens in map(query_tokens, terms) if tokens]
    if not phrases:
        return _nothing(index)
    lists = [
        _phrase_places(index, tokens)
        .withColumn("places", _restrict(F.col("places"), columns, excluded, False))
        .where(F.size("places") > 0)
        for tokens in phrases
    ]
    both = lists[0].withColumnRenamed("places", "p0")
    for number, other in enumerate(lists[1:], 1):
        both = both.join(other.select("doc_id", F.col("places").alias(f"p{number}")), "doc_id")
    counts = _near_counts(both, [distance + len(tokens) for tokens in phrases])
    scored = [
        _score(counts.select("doc_id", "dl", F.col(f"tf{number}").alias("tf")).where("tf > 0"), index, counted=lists[number])
        for number in range(len(phrases))
    ]
    return match_all(*scored)


def _added_up(parts: tuple[DataFrame, ...]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("doc_id").agg(total(F.col("score")).alias("score"), F.count("*").alias("parts"))


def match_all(*parts: DataFrame) -> DataFrame:
    """Documents in every part; one shuffle for any number of parts."""
    return _added_up(parts).where(F.col("parts") == len(parts)).drop("parts")


def match_any(*parts: DataFrame) -> DataFrame:
    """Documents in at least one part."""
    return _added_up(parts).drop("parts")


def match_not(part: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Documents of ``part`` that are not in ``unwanted``, which adds nothing to the score."""
    return part.join(unwanted.select("doc_id"), "doc_id", "left_anti")
