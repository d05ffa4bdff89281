"""A large quality model stays packed, and its training documents are found without a shuffle of texts."""

import numpy as np
from pyspark.sql import functions as F

from trawlight.llm import quality_model
from trawlight.session import Scratch

SCHEMA = "doc_id long, text string, lang string"


def test_a_large_quality_model_is_packed(spark):
    texts = [" ".join(f"w{i * j % 17}" for j in range(30)) for i in range(40)] + [None, "", "one", "the the the the"]
    model = quality_model.fit_tables(spark.createDataFrame([(text,) for text in texts], "text string"))
    ngrams = {("", "")} if any(texts) else set()
    for text in texts:
        words = ["", "", *(text or "").split()]
        for i in range(2, len(words)):
            ngrams |= {(words[i],), (words[i - 1], words[i]), (words[i - 2], words[i - 1], words[i])}
    rows = model.weights.collect()
    keys = np.concatenate([quality_model._unpacked(row["keys"], row["n"]).cumsum() for row in rows])
    # The padding is a context, too.
    assert len(keys) == len(set(keys.tolist())) == len(ngrams) + 1
    for row in rows:
        assert (quality_model._unpacked(row["keys"], row["n"]).cumsum() >> (64 - model.bits) == row["shard"]).all()
    assert quality_model.fit_tables(spark.createDataFrame([("a b",)], "text string"), 1000) is None


def test_texts_to_train_on_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 12).alias("text"), F.lit("en").alias("lang"))
    plans = []
    fit = quality_model.fit_tables

    def noted(texts, *more):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return fit(texts, *more)

    monkeypatch.setattr(quality_model, "fit_tables", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        quality_model.train(docs, docs.selectExpr("doc_id", "1 AS quality"), broadcast_ngrams=0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "hashpartitioning" not in plans[0]


def test_parts_of_a_stored_table_are_dropped(spark):
    scratch = Scratch(spark)
    table = scratch.store_rounds("parts", [spark.range(10).selectExpr("id % 3 AS part", "id")], "part")
    scratch.drop_part("parts", 1)
    assert {row["id"] for row in spark.read.schema(table.schema).parquet(scratch.stored["parts"][0]).collect()} == {0, 2, 3, 5, 6, 8, 9}
    assert {row["id"] for row in table.where("part = 2").collect()} == {2, 5, 8}
