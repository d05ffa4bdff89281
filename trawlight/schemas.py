"""Column layouts shared by the operators."""

from pyspark.sql import types as T

# The stored document: six searchable text columns behind a url key.
SEARCHABLE = ["title", "body", "snippet", "llm_summary", "source_engine", "crawled_timestamp"]
DOCUMENT_COLUMNS = ["url", *SEARCHABLE]

# Keys that must be present (a present NULL counts); the summary is optional.
REQUIRED_KEYS = ["url", "title", "body", "snippet", "source_engine", "crawled_timestamp"]

DOCUMENT = T.StructType([T.StructField(name, T.StringType()) for name in DOCUMENT_COLUMNS])

# A stored document also carries the sequence of its latest insert, which breaks rank ties.
STORED_DOCUMENT = T.StructType([*DOCUMENT.fields, T.StructField("ingest_seq", T.LongType())])

SEARCH_HIT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ["url", "title", "snippet", "llm_summary", "source_engine", "crawled_timestamp"]
    ]
    + [T.StructField("rank", T.DoubleType())]
)
