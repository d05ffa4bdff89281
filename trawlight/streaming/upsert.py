"""Document table fed by a stream.

The stream is keyed by URL. Its state holds the highest ``ingest_seq`` of each URL, so only rows that
change the table go on: late and repeated ones stop there. What goes on is appended, one folder per
micro-batch; a batch that is repeated after a failure overwrites its own folder. The table is the
newest row of each URL over all folders, so the order of batches does not matter. A batch costs its
own size, not that of the table, and texts are not kept in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trawlight.operators.documents import latest_per_url
from trawlight.schemas import STORED_DOCUMENT

_LOWEST = -(1 << 63)


def newest_only(documents: DataFrame) -> DataFrame:
    """The rows of a stream of documents that are newer than all before them with their URL.

    A missing sequence is the lowest. Rows without a URL all go on; they have no state.
    """
    columns = [F.col(field.name).cast(field.dataType) for field in STORED_DOCUMENT]
    rows = documents.select(*columns)

    def pass_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highest = state.get[0] if state.exists else None
        best = None
        for frame in frames:  # one row is kept, however many versions a batch has
            order = frame["ingest_seq"].astype("Int64").fillna(_LOWEST)
            row = frame.loc[[order.idxmax()]]
            number = int(order.max())
            if highest is None or number > highest:
                highest, best = number, row
        if best is not None:
            state.update((highest,))
            yield best

    named = rows.where("url IS NOT NULL").groupBy("url").applyInPandasWithState(
        pass_on, STORED_DOCUMENT, "highest long", "append", GroupStateTimeout.NoTimeout
    )
    return named.unionByName(rows.where("url IS NULL"))


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store what one micro-batch passes on; safe to repeat."""
    rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def start_upserts(documents: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Upsert a stream of documents into the table at ``path``, which belongs to one checkpoint."""
    writer = newest_only(documents).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: append_batch(batch, batch_id, path)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last stored batch."""
    return latest_per_url(spark.read.schema(STORED_DOCUMENT).parquet(path).drop("batch"))
