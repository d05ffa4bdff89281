"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of word expressions: absolute discounting of how many of its documents hold
a word (the Kneser-Ney kind of count: contexts, not tokens), and the discounted mass falls back on
counts shared by both classes. A word seen in no more than ``DISCOUNT`` documents of a class is left to
the shared counts, so rare words say nothing about a class. A text is scored by the
length-normalised difference of its toxic and ordinary log-likelihoods. Differences per word
below a noise floor count as none; the floor, and the logistic curve from difference to score,
are fitted on labelled documents that the counts have not seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlight.llm.common import crc_fold, doc_text
from trawlight.session import materialise

FOLDS = 4
HELD_OUT = 2
CUT = 0.3
DISCOUNT = 3
MAX_TOXIC = 4_000
MAX_ORDINARY = 16_000
FLOORS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
_CALIBRATION = 4  # every fourth training document fits the curve, the others give the counts

_WORD = re.compile(r"\w+")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Log-likelihood differences per word, a noise floor, and the logistic curve."""

    difference: dict[str, float]
    floor: float
    slope: float
    offset: float

    def evidence(self, text: str, floors: tuple[float, ...]) -> list[float]:
        """Mean difference above each floor, per word."""
        words = split_words(text)
        found = [d for d in map(self.difference.get, words) if d is not None]
        return [sum(d - floor for d in found if d > floor) / max(len(words), 1) for floor in floors]

    def score(self, text: str) -> float:
        x = _curve_input(self.evidence(text, (self.floor,))[0])
        return 1 / (1 + math.exp(-min(max(self.slope * x + self.offset, -30.0), 30.0)))


def _curve_input(evidence: float) -> float:
    return math.log(evidence + 1e-4) - math.log(1e-4)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_ordinary: int) -> DataFrame:
    """``(text, toxic, fold)`` of the training documents of each class with the smallest hash of ``doc_id``.

    A document with several labels is toxic if one of them says so; labels other than 0 and 1, and
    rows without a ``doc_id``, do not count.
    """
    own = (
        labels.select(labels["doc_id"].alias("_tl_id"), labels["toxic"].alias("_tl_toxic"))
        .where(F.col("_tl_toxic").isin(0, 1) & (crc_fold(F.col("_tl_id"), FOLDS) != HELD_OUT))
        .groupBy("_tl_id")
        .agg(F.max("_tl_toxic").alias("toxic"))
    )
    order = [F.xxhash64("_tl_id"), F.col("_tl_id")]
    chosen = own.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(
        own.where("toxic = 0").orderBy(*order).limit(max_ordinary)
    )
    texts = doc_text(docs)
    found = texts.join(materialise(chosen, "labelled"), texts["doc_id"] == F.col("_tl_id"))
    return found.select("text", "toxic", (F.pmod(F.xxhash64("_tl_id", F.lit(1)), F.lit(_CALIBRATION)) == 0).alias("fit"))


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, toxic, ordinary)``: how many documents of each class hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for word in set(split_words(text.as_py())):
                    counts.setdefault(word, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(counts.keys(), pa.string()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                ],
                ["word", "toxic", "ordinary"],
            )

    found = texts.select("text", "toxic").mapInArrow(run, "word string, toxic long, ordinary long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    discount: int = DISCOUNT,
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
) -> Model:
    """Fit on at most ``max_toxic`` and ``max_ordinary`` labelled documents outside the held-out fold.

    Only words seen in more than ``discount`` documents of a class have a difference of their own,
    and only they reach the driver. Without documents of both classes every text scores the share
    of toxic labels, 0 if there are none.
    """
    sample = materialise(labelled_sample(docs, labels, max_toxic, max_ordinary), "labelled-texts")
    counts = materialise(count_words(sample.where(~F.col("fit"))), "word-counts")
    totals = counts.agg(
        F.sum("toxic"),
        F.sum("ordinary"),
        F.sum(F.least("toxic", F.lit(discount))),
        F.sum(F.least("ordinary", F.lit(discount))),
    ).first()
    n_t, n_o, held_t, held_o = (float(x or 0) for x in totals)
    if not n_t or not n_o:
        shares = [row[0] for row in sample.select(F.avg("toxic")).collect()]
        share = min(max(shares[0] or 0.0, 1e-9), 1 - 1e-9)
        return Model({}, FLOORS[0], 0.0, math.log(share / (1 - share)))
    shared = (F.col("toxic") + F.col("ordinary")) / (n_t + n_o)

    def p(name: str, total: float, held: float):
        return F.greatest(F.col(name) - discount, F.lit(0)) / total + held / total * shared

    # The difference between the fallback masses is that of an unknown word; it is taken as zero.
    base = math.log(held_t / n_t) - math.log(held_o / n_o)
    rows = (
        counts.where((F.col("toxic") > discount) | (F.col("ordinary") > discount))
        .select("word", (F.ln(p("toxic", n_t, held_t)) - F.ln(p("ordinary", n_o, held_o)) - base).alias("d"))
        .where(F.col("d") > FLOORS[0])
        .collect()
    )
    model = Model({row["word"]: row["d"] for row in rows}, FLOORS[0], 0.0, 0.0)
    return _calibrate(model, sample.where("fit"))


def _calibrate(model: Model, texts: DataFrame) -> Model:
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.evidence(text.as_py(), FLOORS) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "evidence"]
            )

    rows = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, evidence array<double>").collect()
    y = np.array([row["toxic"] for row in rows], float)
    best = None
    for i, floor in enumerate(FLOORS):
        x = np.array([_curve_input(row["evidence"][i]) for row in rows])
        slope, offset, loss = fit_logistic(x, y)
        if best is None or loss < best[0]:
            best = loss, floor, slope, offset
    return Model(model.difference, best[1], best[2], best[3])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Slope, offset and mean loss of a logistic curve, by Newton steps."""
    if not len(x):
        return 1.0, -1.0, math.inf
    design = np.stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        gradient = design @ (p - y) + ridge * w
        hessian = (design * (p * (1 - p))) @ design.T + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    p = np.clip(1 / (1 + np.exp(-np.clip(w @ design, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Scores depend on the text alone; null and empty texts score like a text without any toxic
    evidence. ``held_out`` is null for a null ``doc_id``. Repeated rows are scored one by one. An
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(text.as_py()) for text in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), scores], ["doc_id", "score"])

    scored = doc_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
