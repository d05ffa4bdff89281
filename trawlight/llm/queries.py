"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.llm import (
    codes,
    fertility,
    fim,
    interpolation,
    licenses,
    mixing,
    packing,
    quality_model,
    set_join,
    simhash,
    token_file,
    topk,
    toxicity,
)
from trawlight.llm.common import table
from trawlight.llm.tokens import default_vocabulary
from trawlight.session import scratch_path


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token file of all documents and returns what a reader finds in it."""
    path = scratch_path(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return token_file.read_tokens(spark, path)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_copy").alias("copy"), "source", "lang", "n_chars", "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())


def op10_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_sets(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        *["doc_id", "n", "form", "prefix_chars", "middle_chars"],
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_token_file,
        op2_quality_classifier,
        op3_quality_rules,
        op4_license_scan,
        op5_topk,
        op6_toxicity,
        op7_mixing,
        op8_simhash,
        op9_packing,
        op10_interpolation,
        op11_set_join,
        op12_vector_codes,
        op13_fill_in_middle,
    )
}
