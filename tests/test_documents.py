"""Upserts, required keys, snapshots and the streaming table."""

import json

import pytest
from pyspark.sql import functions as F

from trawlight.operators import documents as d
from trawlight.schemas import DOCUMENT_COLUMNS, STORED_DOCUMENT
from trawlight.sources import documents as store
from trawlight.streaming.upsert import append_batch, read_current, start_upserts

KILN = ("http://clay.example/kiln", "Firing a kiln", "Raise the heat slowly for two hours.", "Raise the heat", "How to fire.", "crawler", "2023-05-01T08:00:00Z")
GLAZE = ("http://clay.example/glaze", "Ash glaze", "Wood ash, feldspar and water.", "Wood ash", None, "crawler", "2023-05-01T08:05:00Z")
KILN_AGAIN = ("http://clay.example/kiln", "Firing a kiln, revised", "Raise the heat for three hours, then soak.", "Raise, then soak", "Longer firing.", "recrawl", "2023-06-01T08:00:00Z")
WHEEL = ("http://clay.example/wheel", "Wheel", "Centre the clay.", "Centre", None, "crawler", "t")
GLAZE_AGAIN = ("http://clay.example/glaze", "Salt glaze", "Salt.", "Salt", "Salty.", "crawler", "t")


def table(spark, *documents, start=1):
    return spark.createDataFrame([(*row, n) for n, row in enumerate(documents, start)], STORED_DOCUMENT)


def rows(df):
    return sorted((tuple(r)[:7] for r in df.select(*DOCUMENT_COLUMNS).collect()), key=str)


def test_insert_and_replace(spark):
    first = d.upsert(table(spark), table(spark, KILN))
    assert rows(first) == [KILN]
    assert rows(d.upsert(first, table(spark, KILN_AGAIN, start=2))) == [KILN_AGAIN]
    assert rows(d.upsert(first, table(spark, GLAZE, start=2))) == sorted([KILN, GLAZE])


def test_batch_later_row_wins(spark):
    existing = table(spark, KILN, GLAZE)
    assert d.next_sequence(existing) == 3
    assert rows(d.upsert(existing, table(spark, WHEEL, GLAZE_AGAIN, start=3))) == sorted([KILN, WHEEL, GLAZE_AGAIN])
    assert rows(d.upsert(table(spark), table(spark, KILN, KILN_AGAIN))) == [KILN_AGAIN]


def test_null_urls_accumulate(spark):
    nameless = (None, *KILN[1:])
    merged = d.upsert(table(spark, nameless), table(spark, nameless, nameless, start=2))
    assert merged.count() == 3


def test_required_keys_need_presence_only(spark):
    full = dict(zip(DOCUMENT_COLUMNS, GLAZE))
    partial = {"url": "u", "title": "t"}
    without_body = {key: value for key, value in full.items() if key != "body"}
    null_body = {**full, "body": None}
    no_summary = {key: value for key, value in full.items() if key != "llm_summary"}
    lines = [(n, json.dumps(one)) for n, one in enumerate([full, partial, without_body, null_body, no_summary])]
    parsed = d.documents_from_json(spark.createDataFrame(lines, "n int, document string"), "document", ["n"])
    assert sorted(r.n for r in parsed.collect()) == [0, 3, 4]


def test_delete(spark):
    keys = spark.createDataFrame([(KILN[0],), (None,)], "url string")
    kept = d.delete_by_url(table(spark, KILN, GLAZE, (None, *KILN[1:])), keys)
    assert sorted(str(r.url) for r in kept.collect()) == ["None", GLAZE[0]]


def test_stored_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert store.read_documents(spark, path).count() == 0
    store.create_if_absent(spark, path, range_rows=2)
    store.create_if_absent(spark, path)
    first = store.upsert_documents(table(spark, KILN, GLAZE, WHEEL), path)
    assert first.removed.count() == 0
    current = store.read_documents(spark, path)
    assert current.columns == [*DOCUMENT_COLUMNS, "ingest_seq"]
    assert store.lookup(current, GLAZE[0]).first().llm_summary is None
    # A failed upsert leaves all rows in place, a repeated one changes nothing.
    broken = table(spark, KILN_AGAIN, start=9).withColumn("title", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        store.upsert_documents(broken, path)
    assert rows(store.read_documents(spark, path)) == sorted([KILN, GLAZE, WHEEL])
    for _ in range(2):
        change = store.upsert_documents(table(spark, KILN_AGAIN, GLAZE_AGAIN, start=9), path)
        assert rows(store.read_documents(spark, path)) == sorted([KILN_AGAIN, GLAZE_AGAIN, WHEEL])
    assert sorted(r.doc_id for r in change.removed.collect()) == [9, 10]
    assert d.next_sequence(store.read_documents(spark, path)) == 11


def test_upsert_rewrites_only_the_ranges_it_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    many = [(f"u{n}", *KILN[1:]) for n in range(1, 41)]
    store.upsert_documents(table(spark, *many), path, range_rows=10)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table" / "rows").rglob("*.parquet")}
    before = files()
    store.upsert_documents(table(spark, ("u13", *GLAZE[1:]), (None, *GLAZE[1:]), start=100), path)
    after = files()
    changed = {name.split("seq_range=")[1].split("/")[0] for name in before.items() ^ after.items() for name in name[:1]}
    assert changed == {"1", "10"}
    assert store.read_documents(spark, path).count() == 41
    # A range that loses all its rows reads as empty.
    store.upsert_documents(table(spark, *[(f"u{n}", *WHEEL[1:]) for n in range(20, 30)], start=200), path)
    ranged = store.read_ranged(spark, path)
    assert ranged.of_ranges([2]).count() == 0 and ranged.rows.count() == 41
    assert "seq_range" in ranged.of_ranges([1])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_stream_equals_batch_in_any_order_and_over_restarts(spark, tmp_path):
    source, path, state = (str(tmp_path / name) for name in ("source", "table", "state"))
    nameless = (None, *KILN[1:])
    # Late rows, rows that come twice, several versions in one batch, rows without URL.
    batches = [([KILN_AGAIN], 50), ([KILN, GLAZE, nameless], 1), ([KILN_AGAIN], 50), ([WHEEL, GLAZE, GLAZE_AGAIN, nameless], 60)]
    for documents, start in batches:
        table(spark, *documents, start=start).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STORED_DOCUMENT).option("maxFilesPerTrigger", 1).parquet(source)
        start_upserts(stream, path, state, available_now=True).awaitTermination()
    assert rows(read_current(spark, path)) == sorted([KILN_AGAIN, WHEEL, GLAZE_AGAIN, nameless, nameless], key=str)
    stored = spark.read.parquet(path)
    assert stored.where(F.col("url") == KILN[0]).count() == 1  # neither the late nor the repeated row went on
    append_batch(stored.where("batch = 0").drop("batch"), 0, path)
    assert read_current(spark, path).count() == 5


def test_hot_url_is_cut_before_the_shuffle(spark):
    plan = d.latest_per_url(table(spark, KILN))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
