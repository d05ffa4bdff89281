"""Tables in ranges of a sequence number, one folder per range, changed range by range.

A row's folder follows from its number, so a change rewrites the folders of the rows it replaces and of
the rows it adds, and no others: Spark's dynamic partition overwrite writes them aside and moves them in
when the job commits. A job that fails leaves the table as it was. A folder that loses all its rows is
overwritten by a row that is not ``held``, which no reader sees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "seq_range"
RANGE_ROWS = 1 << 20
# Folders that a task may have to empty, and tasks for each core that list them.
TASK_FOLDERS = 256
LISTINGS = 16


@dataclass(frozen=True)
class RangedTable:
    """Rows with their ``seq_range``, and how many numbers a range has."""

    rows: DataFrame
    range_rows: int

    def of_ranges(self, ranges: Sequence[int]) -> DataFrame:
        """The rows of some ranges; no other folder is opened."""
        numbers = ", ".join(str(number) for number in ranges if number is not None)
        return self.rows.where(f"{RANGE} IN ({numbers})" if numbers else "false")


def range_of(number: Column, range_rows: int) -> Column:
    return F.floor(number / range_rows).cast("long")


def ranges_in(numbers: DataFrame, number: str, range_rows: int) -> list[int]:
    """The ranges that occur; at most one value per range reaches the driver."""
    return [row[0] for row in numbers.select(range_of(F.col(number), range_rows)).distinct().collect()]


def write_layout(spark: SparkSession, path: str, **numbers: int) -> None:
    layout = ", ".join(f"{name} long" for name in numbers)
    spark.createDataFrame([tuple(numbers.values())], layout).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read_layout(spark: SparkSession, path: str) -> dict[str, int] | None:
    """The numbers a table was laid out with; None if there is no table."""
    try:
        return spark.read.parquet(f"{path}/layout").first().asDict()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_ranges(spark: SparkSession, path: str, schema: str, range_rows: int) -> RangedTable:
    """The table; its folders are listed by a few tasks for each core, as a task for each takes longer to start than to run."""
    limit, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTINGS * spark.sparkContext.defaultParallelism
    before = spark.conf.get(limit)
    spark.conf.set(limit, min(int(before), tasks))
    try:
        rows = spark.read.schema(f"{schema}, held boolean, {RANGE} long").parquet(path)
    finally:
        spark.conf.set(limit, before)
    return RangedTable(rows.where("held").drop("held"), range_rows)


def write_ranges(
    rows: DataFrame,
    path: str,
    ranges: Sequence[int] | None = None,
    by: tuple[str, int] | None = None,
    order: Sequence[str] = (),
    filled: DataFrame | None = None,
) -> None:
    """Write rows that carry their ``seq_range`` into its folders, in ``order`` inside a folder.

    ``ranges`` are the folders to replace, those without rows too; without it the whole table is
    written anew. ``by`` names a second folder level and its number of values from 0. The rows
    should be partitioned by these columns already. ``filled`` has the folders of the rows, where these
    are found in less than a second run of ``rows``; only the others are emptied, in tasks of a few folders each.
    """
    spark, levels = rows.sparkSession, [RANGE, *([by[0]] if by else [])]
    held = rows.withColumn("held", F.lit(True))
    if ranges is None:
        held.sortWithinPartitions(*levels, *order).write.mode("overwrite").partitionBy(*levels).parquet(path)
        return
    gone = spark.createDataFrame([(number,) for number in ranges], f"{RANGE} long").withColumn("held", F.lit(False))
    if by:
        gone = gone.withColumn(by[0], F.explode(F.sequence(F.lit(0), F.lit(by[1] - 1))))
    gone = gone.join((rows if filled is None else filled).select(*levels).distinct(), levels, "left_anti")
    gone = gone.repartition(1 + len(ranges) * (by[1] if by else 1) // TASK_FOLDERS, *levels)
    # Sorted once, after the union, which does not keep the order of its parts.
    everything = held.unionByName(gone, allowMissingColumns=True).sortWithinPartitions(*levels, *order)
    writer = everything.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*levels).parquet(path)
