"""Shared storage, numbering, and the plans that large tables depend on."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trawlight import session as s
from trawlight.operators import robots as r
from trawlight.operators.index import build_index, posting_list, read_index, write_index
from trawlight.operators.match import match_term
from trawlight.operators.search import top_matches
from trawlight.schemas import STORED_DOCUMENT
from trawlight.sources.pages import page_fetch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_dense_and_follow_the_order(spark):
    rnd = random.Random(2)
    # A third of all rows share the first key.
    rows = [(0 if n % 3 == 0 else rnd.randint(0, 50), n) for n in range(5000)]
    rnd.shuffle(rows)
    numbered, count = s.number_and_count(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n", 11)
    got = sorted((row.n, row.a, row.b) for row in numbered.collect())
    assert count == 5000
    assert [row[0] for row in got] == list(range(11, 5011))
    assert [row[1:] for row in got] == sorted(rows)


def test_numbering_nothing(spark):
    numbered, count = s.number_and_count(spark.createDataFrame([], "a int"), ["a"], "n")
    assert count == 0 and numbered.collect() == []


def test_scratch_folder_comes_from_the_session():
    shared = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/folder/"})
    assert s.scratch_root(shared) == "hdfs://shared/folder"
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError):
        s.scratch_root(cluster)


def test_spread_leaves_large_scans_alone(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartition(16).write.parquet(path)
    scan = spark.read.parquet(path)
    assert s.spread(scan.coalesce(2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    enough = scan.repartition(16)
    assert s.spread(enough) is enough


def test_small_frontier_is_broadcast_to_the_page_store(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(2000).select(
        F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit("<p>").alias("html")
    ).write.parquet(path)
    frontier, _ = s.number_and_count(spark.createDataFrame([("http://h/1",), ("http://h/x",)], "url string"), ["url"], "pos")
    fetched = page_fetch(frontier, spark.read.parquet(path))
    assert "BroadcastHashJoin" in plan_of(fetched) and "SortMergeJoin" not in plan_of(fetched)
    assert {row.url: row.html for row in fetched.collect()} == {"http://h/1": "<p>", "http://h/x": None}


def test_stored_index_reads_one_folder_and_spreads_a_hot_term(spark, tmp_path):
    rows = [(f"u{n}", "common", f"word{n % 7}", "s", None, "crawler", "2024", n) for n in range(400)]
    path = str(tmp_path / "index")
    # So little data would otherwise be put together into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_index(spark.createDataFrame(rows, STORED_DOCUMENT), path, buckets=4, range_rows=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = read_index(spark, path)
    hot = posting_list(index, ["common"])
    assert "term_bucket" in plan_of(hot).split("PartitionFilters")[1][:120]
    assert hot.count() == 400
    assert hot.select(F.input_file_name()).distinct().count() > 1
    # A single term is scored and cut without a shuffle of its postings.
    assert "Exchange hashpartitioning" not in plan_of(top_matches(match_term(index, "common")))


def test_index_of_empty_and_long_rows(spark):
    rows = [("u1", None, None, None, None, None, None, 1), ("u2", "a " * 3000 + "b", "", "", None, "e", "x", 2)]
    postings = {(p.doc_id, p.term): p for p in build_index(spark.createDataFrame(rows, STORED_DOCUMENT)).postings.collect()}
    assert postings[(1, "")].dl == 0 and postings[(2, "")].dl == 3003
    assert postings[(2, "a")].tf == 3000 and postings[(2, "b")].places == [3000]
    assert set(postings) == {(1, ""), (2, ""), (2, "a"), (2, "b"), (2, "e"), (2, "x")}


def test_one_host_with_most_pages(spark):
    hosts = spark.createDataFrame([("big.org", "User-agent: *\nDisallow: /odd"), ("small.org", "User-agent: *\nDisallow: /")], "netloc string, text string")
    urls = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://small.org/"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("http://big.org/"), F.when(F.col("id") % 2 == 1, "odd").otherwise("even"), F.col("id").cast("string")))
        .alias("url")
    )
    allowed = r.robots_allowed(urls, r.host_policies(r.robots_rules(hosts), "bot"))
    assert allowed.count() == 3000
    assert allowed.where("allowed").count() == sum(1 for n in range(3000) if n % 10 and n % 2 == 0)
