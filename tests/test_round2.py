"""Inputs the registered queries do not give: unknown engines, rows without URL, other local masters."""

import html
import html.entities

from pyspark.sql import functions as F

from trawlight.functions.html import decode_references

from trawlight.operators.documents import latest_per_url
from trawlight.operators.metasearch import select_engines
from trawlight.sources.engines import ENGINE_ORDER


def test_unknown_engines_have_no_effect(spark):
    results = spark.createDataFrame([("bing",), (ENGINE_ORDER[0],)], "source_engine string")
    assert select_engines(results, ["bing"]).count() == 0
    assert select_engines(results, ["bing", ENGINE_ORDER[0]]).count() == 1


def test_rows_without_url_all_stay(spark):
    rows = [(None, 1), (None, 1), (None, None), (None, None), ("u", 1), ("u", 2)]
    found = latest_per_url(spark.createDataFrame(rows, "url string, ingest_seq long")).collect()
    assert sorted(map(str, found)) == sorted(
        ["Row(url=None, ingest_seq=1)"] * 2 + ["Row(url=None, ingest_seq=None)"] * 2 + ["Row(url='u', ingest_seq=2)"]
    )


def test_character_references_equal_the_standard_library(spark):
    codes = [*range(0, 300), 0x7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000]
    texts = [form.format(code) for code in codes for form in ("a&#{};b", "a&#{} b", "&#x{:x};", "&#X{:X}", "&#000000{};")]
    texts += [f"x &{name} y" for name in html.entities.html5] + ["&#99999999999999999999;", "&#x0000041;", "&#;", "&#x;", "&"]
    texts += ["AT&T", "&ampamp;", "&notit;", "&notin;", "&copy2024", "&unknown;", "a=1&lt=2&amp", "&&lt;&", "&#65&#66;", "no"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    got = rows.select("text", decode_references(F.col("text")).alias("decoded")).collect()
    assert {row.text: row.decoded for row in got} == {text: html.unescape(text) for text in texts}
