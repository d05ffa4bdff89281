"""Session helpers: shared scratch storage and row numbering that no single task has to finish."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def local_session(cpus: int | str = 8, app_name: str = "trawlight") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine: on a cluster such a
    folder would be lost with the executor that wrote it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="trawlight-")
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark)}/trawlight/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to shared storage, by default to a new path, and return the stored table.

    Cuts the lineage like a checkpoint, but runs the plan once instead of twice and gives a
    columnar table that later steps prune.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one computation, which go as soon as nothing reads them any more.

    The shuffle files of a step go with its end as well, not when the driver happens to collect its garbage.
    """

    _FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.stored: dict[str, tuple[str, DataFrame]] = {}

    def store(self, label: str, df: DataFrame) -> DataFrame:
        return self.store_rounds(label, [df])

    def store_rounds(self, label: str, rounds: Iterable[DataFrame], by: str | None = None) -> DataFrame:
        """One table of the rows of all rounds, which run one after the other, each with shuffle files of its own.

        Stored ``by`` a column of numbers, the table can be dropped part by part.
        """
        path, before = scratch_path(self.spark, label), self.spark.conf.get(self._FREES, "false")
        self.spark.conf.set(self._FREES, "true")
        try:
            for df in rounds:
                df.write.mode("append").parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(self._FREES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.stored[label] = (path, table)
        return table

    def drop_part(self, label: str, value: int) -> None:
        """Empty the part of a table that was stored ``by`` a column, which no result may read later on."""
        path, table = self.stored[label]
        *rest, by = table.schema.names  # read again, the column stands last
        self.spark.createDataFrame([], table.select(*rest).schema).write.mode("overwrite").parquet(f"{path}/{by}={value}")

    def drop(self, *labels: str) -> None:
        """Empty tables, by default all, that no result may read later on."""
        for label in labels or [*self.stored]:
            path, table = self.stored.pop(label)
            self.spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def number_and_count(
    df: DataFrame, order: list[str | Column], name: str, start: int = 1, path: str | None = None
) -> tuple[DataFrame, int]:
    """Add a dense 1-step number over a total order; also return how many rows there are.

    Rows are range-partitioned by the order key and numbered inside their partition; the row
    counts of the partitions before give the offset. The stored table in between pins each row
    to its partition, so a retried task cannot renumber rows. One number per partition reaches
    the driver and comes back as an array literal, not as a join, so the result keeps the size of
    its files as statistics: the planner broadcasts it later on only if that size is small.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    stored = (
        materialise(ranged, "numbered", path)
        .withColumn("_part", F.shiftright("_slot", 33))
        .withColumn("_row", F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = stored.groupBy("_part").agg((F.max("_row") + 1).alias("_size")).orderBy("_part").collect()
    ends = list(accumulate(row["_size"] for row in sizes))
    offsets = [0] * (sizes[-1]["_part"] + 1 if sizes else 0)
    for row, end in zip(sizes, ends):
        offsets[row["_part"]] = start + end - row["_size"]
    table = F.from_json(F.lit(json.dumps(offsets)), "array<bigint>")
    numbered = stored.withColumn(name, F.get(table, F.col("_part").cast("int")) + F.col("_row"))
    return numbered.drop("_slot", "_part", "_row"), ends[-1] if ends else 0


def number_rows(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Add a dense 1-step number over a total order, without one task that sees all rows."""
    return number_and_count(df, order, name, start)[0]


def spread(scan: DataFrame) -> DataFrame:
    """Spread the rows of a file scan over the cores when it has too few splits for them.

    Meant for small tables in few files that go through expensive expressions. A table with at
    least one split per core passes unchanged, so large tables are never shuffled here. Give it a
    plain scan: counting the splits must not run anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
