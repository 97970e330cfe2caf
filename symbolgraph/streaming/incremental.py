"""Keeping a graph up to date from a stream of changed sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def follow(changes: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """changes (file, content): each batch's extracted rows replace, file by file, what the table at path holds of them.

    The table is partitioned by file batch: a batch is written under its number, so a batch that is run again after
    a failure overwrites itself; `current` reads the last batch of each file.
    """

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(table: DataFrame, file_col: str = "file") -> DataFrame:
    """Of a table that follow() wrote, each file's rows of its last batch."""
    from pyspark.sql import functions as F

    last = table.groupBy(file_col).agg(F.max("batch").alias("batch"))
    return table.join(last, [file_col, "batch"]).drop("batch")
