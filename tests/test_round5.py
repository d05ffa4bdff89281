"""Updates of an index that has very many folders."""

from pyspark.sql import functions as F

from trawlight.operators.index import build_index, read_index, update_index, updated_index, write_index
from trawlight.session import scratch_path
from trawlight.sources import ranges

POSTING = ["term", "doc_id", "dl", "tf", "cast(places AS string) AS places"]


def texts(spark, first, last):
    return spark.range(first, last).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat(F.lit("w"), (F.col("id") * n % 97).cast("string")))).alias("body"),
        F.col("id").alias("ingest_seq"),
    )


def stored_files(spark, path, levels):
    """Of every folder: its files, its rows, and those that no reader sees."""
    rows = spark.read.schema(", ".join(["term string", "held boolean", *(f"{name} long" for name in levels)])).parquet(path)
    grouped = rows.withColumn("file", F.input_file_name()).groupBy(*levels).agg(
        F.count_distinct("file"), F.count(F.lit(1)), F.count_if(~F.col("held")), F.min("file")
    )
    return {tuple(row)[: len(levels)]: tuple(row)[len(levels) :] for row in grouped.collect()}


def checked(spark, path, expected):
    index = read_index(spark, path)
    assert sorted(index.postings.selectExpr(*POSTING).collect()) == sorted(expected.selectExpr(*POSTING).collect())
    dictionary = index.terms.groupBy("term").agg(F.sum("df"), F.sum("length"), F.max("most"), F.min("shortest"))
    terms = expected.groupBy("term").agg(F.count(F.lit(1)), F.sum("dl"), F.max("tf"), F.min("dl"))
    assert sorted(map(tuple, dictionary.collect())) == sorted(map(tuple, terms.collect()))


def test_an_update_writes_one_file_to_a_folder_that_keeps_rows(spark):
    before, path = texts(spark, 0, 100), scratch_path(spark, "updated-folders")
    write_index(before, path, buckets=4, range_rows=20)
    removed, added = before.where("ingest_seq % 7 = 0").select(F.col("ingest_seq").alias("doc_id")), texts(spark, 100, 115)
    after = updated_index(build_index(before), removed, added).postings
    for _ in range(2):  # a repeated update changes nothing
        update_index(spark, path, removed, added)
        checked(spark, path, after)
        folders = stored_files(spark, f"{path}/postings", ["seq_range", "term_bucket"])
        assert len(folders) == 24 and all(found[0] == 1 and found[2] == 0 for found in folders.values())
        folders = stored_files(spark, f"{path}/terms", ["seq_range"])
        assert len(folders) == 6 and all(found[0] == 1 and found[2] == 0 for found in folders.values())


def test_folders_that_lose_all_rows_are_emptied_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_FOLDERS", 4, raising=False)
    before, path = texts(spark, 0, 100), scratch_path(spark, "emptied-folders")
    write_index(before, path, buckets=4, range_rows=10)
    removed, added = before.where("ingest_seq < 80").select(F.col("ingest_seq").alias("doc_id")), texts(spark, 100, 105)
    after = updated_index(build_index(before), removed, added).postings
    for _ in range(2):
        update_index(spark, path, removed, added)
        checked(spark, path, after)
        folders = stored_files(spark, f"{path}/postings", ["seq_range", "term_bucket"])
        emptied = {place: found for place, found in folders.items() if found[2]}
        assert {place[0] for place in emptied} == set(range(8)) and len(emptied) == 32 and len(folders) == 44
        assert all(found[:3] == (1, 1, 1) for found in emptied.values())
        # Files of one task have its number in their names.
        assert len({found[3].split("/part-")[1][:5] for found in emptied.values()}) > 1
        assert {place[0] for place, found in stored_files(spark, f"{path}/terms", ["seq_range"]).items() if found[2]} == set(range(8))
