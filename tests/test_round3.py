"""Whole training of the quality classifier; what index and batch search move."""

from pyspark.sql import functions as F

from trawlight.llm import quality_model
from trawlight.operators import search
from trawlight.operators.index import read_index, write_index
from trawlight.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_quality_model_is_fitted_on_all_trusted_documents_not_held_out(spark):
    docs = spark.range(2801).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 2800, F.repeat(F.lit("very long text "), 5_000)).otherwise("one two").alias("text"),
        F.lit("en").alias("lang"),
    )
    _, sample = quality_model.train(docs, docs.selectExpr("doc_id", "1 AS quality"))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(quality_model.HELD_FOLDS)) == 0
    expected = {row[0] for row in docs.where(~held).select("doc_id").collect()}
    # The only text of twenty words is the one that its language holds out.
    assert {row[0] for row in sample.collect()} == expected - {2800} and len(expected) > 2000
    long = docs.unionByName(docs.where("doc_id = 2800").selectExpr("doc_id + 1 AS doc_id", "text", "lang"))
    _, sample = quality_model.train(long, long.selectExpr("doc_id", "1 AS quality"))
    assert sample.where("_tl_id >= 2800").count() == 1


def test_a_sharded_quality_model_scores_like_one_in_memory(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, "en"), (None, "", None), (-2, " \n", "en"), (-3, "one", None), (-3, "the unheardof one", "en")], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd).unionByName(docs.where("doc_id < 9").select("doc_id", "text", "lang"))
    shards, _ = quality_model.train(docs, labels, broadcast_ngrams=0)
    assert isinstance(shards, quality_model.Tables)

    def judged(**options):
        rows = quality_model.judge(docs, labels, **options).collect()
        return sorted(rows, key=lambda row: (row["doc_id"] or 0, row["n_words"], row["lang"] or ""))

    kept = []
    for one, other in zip(judged(), judged(broadcast_ngrams=0), strict=True):
        assert one["doc_id"] == other["doc_id"] and one["n_words"] == other["n_words"] and one["kept"] == other["kept"]
        for name in ("perplexity", "threshold"):
            assert (one[name] is None) == (other[name] is None)
            assert one[name] is None or abs(one[name] / other[name] - 1) < 1e-5
        kept += [one["doc_id"]] * one["kept"]
    some = quality_model.keep_good(docs, labels, broadcast_ngrams=0)
    assert some.columns == docs.columns
    assert sorted(row["doc_id"] or 0 for row in some.collect()) == sorted(number or 0 for number in kept)


def test_ngrams_of_documents_are_shuffled_packed(spark):
    words = spark.range(-5, 2000).select(*[F.xxhash64(F.lit(i), "id").alias(f"w{i}") for i in range(3)])
    arrays = [words.toArrow().column(f"w{i}").to_numpy() for i in range(3)]
    for n in (1, 2, 3):
        expected = words.select(quality_model._key(*[f"w{i}" for i in range(n)])).toArrow().column(0).to_numpy()
        assert (quality_model._keys(*arrays[:n]) == expected).all()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select(F.xxhash64("text").alias("slot"), "text")
    rows = quality_model._asked(texts, 2).collect()
    moved = sum(len(row[name] or b"") for row in rows for name in ("keys", "places", "times", "slots"))
    # A row of text, key and number for each n-gram would be 24 bytes.
    assert moved < 9 * sum(row["n"] for row in rows)
    for row in rows:
        keys = quality_model._unpacked(row["keys"], row["n"]).cumsum()
        assert (keys >> 62 == row["shard"]).all() and (keys[1:] >= keys[:-1]).all()
    assert {row["shard"] for row in rows} == {-2, -1, 0, 1}


def test_an_index_of_short_ranges_moves_texts_and_not_postings(spark, monkeypatch):
    texts = spark.range(90).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat(F.lit("w"), (F.col("id") * n % 97).cast("string")))).alias("body"),
        F.col("id").alias("ingest_seq"),
    )
    moved = []
    repartition = type(texts).repartition

    def noted(frame, *by):
        moved.append(frame.columns)
        return repartition(frame, *by)

    monkeypatch.setattr(type(texts), "repartition", noted)
    found = []
    for range_rows in (20, 1 << 20):
        path = scratch_path(spark, "short-ranges")
        write_index(texts, path, buckets=4, range_rows=range_rows)
        index = read_index(spark, path)
        terms = index.terms.groupBy("term").agg(F.sum("df"), F.sum("length"), F.max("most"), F.min("shortest"))
        rows = index.postings.select("term", "doc_id", "dl", "tf", F.col("places").cast("string"), "term_bucket")
        found.append((sorted(rows.collect()), sorted(terms.collect())))
        files = index.postings.select(F.input_file_name().alias("file"), "seq_range", "term_bucket").distinct()
        assert files.count() == files.select("seq_range", "term_bucket").distinct().count()
    assert found[0] == found[1] and len(found[0][0]) > 90
    assert not any("places" in columns for columns in moved[:2]) and any("places" in columns for columns in moved[2:])


def test_a_batch_search_moves_only_the_lists_of_its_queries(spark, monkeypatch):
    texts = spark.range(60).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("common w"), (F.col("id") % 7).cast("string"), F.lit(" x"), F.col("id").cast("string")).alias("body"),
        F.col("id").alias("ingest_seq"),
    )
    path = scratch_path(spark, "batch-lists")
    write_index(texts, path, buckets=1, range_rows=20)
    queries = spark.createDataFrame([(1, "common x25"), (2, "w3 common"), (3, "absent common")], "query_id long, query string")
    stored = {}

    def noted(df, label, *more, keep=search.materialise):
        table = keep(df, label, *more)
        stored.setdefault(label, []).append(table)
        return table

    monkeypatch.setattr(search, "materialise", noted)
    hits = search.search_batch(queries, read_index(spark, path), limit=2)
    assert {(row["query_id"], row["doc_id"]) for row in hits.collect()} == {(1, 25), (2, 3), (2, 10)}
    lists = [{(row["seq_range"], row["term"]) for row in table.collect()} for table in stored["needed-lists"]]
    # In the first round a range has only the terms of the queries that are best there.
    assert all(term in ("common", "x25", "w3") for some in lists for _, term in some)
    assert {place for place, term in lists[0] if term == "x25"} == {1} and len(lists[0]) <= 4
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2
