"""A training corpus from raw documents: quality rules, quality classifier, near-duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.llm import fertility, mixing, packing, quality_model, simhash
from trawlight.llm.common import table
from trawlight.llm.tokens import default_vocabulary
from trawlight.session import materialise

BATCH_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so a batch that goes to Python or back has ``BATCH_ROWS`` of them, not the 10,000 of narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose tokenizer fertility fits their language."""
    _short_batches(spark)
    return fertility.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted documents is low enough."""
    _short_batches(spark)
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by rows: repeated or null ids lose no text.

    The row with the smallest ``doc_id`` stays; a row without an id stays only if its group has none with one.
    The rows are numbered and stored first, so that the numbers hold; texts are not shuffled. An
    empty table stays empty.
    """
    _short_batches(spark)
    numbered = materialise(docs.withColumn("_tl_row", F.monotonically_increasing_id()), "numbered-documents")
    first = materialise(simhash.first_of_groups(numbered, "_tl_row"), "first-of-group")
    return numbered.join(first, "_tl_row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix_sources(docs).drop("_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence of tokens."""
    _short_batches(spark)
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# SQL expresses neither tokenizers and XXH64 nor the fitted models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
