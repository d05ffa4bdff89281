"""Seed list: a text source with one URL per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlight.functions.text import strip
from trawlight.session import number_rows


def seed_frontier(lines: DataFrame, order: list[str | Column]) -> DataFrame:
    """``(url, depth, pos)`` of the non-blank lines; duplicates stay, positions follow the order."""
    seeds = lines.withColumn("url", strip(F.col("value"))).where(F.col("url") != "")
    numbered = number_rows(seeds, order, "pos")
    return numbered.select("url", F.lit(0).alias("depth"), "pos")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a text file or folder in file and line order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return seed_frontier(lines, ["_file", "_block", "_line"])
