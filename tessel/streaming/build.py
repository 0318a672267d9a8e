"""Incremental build of a table of latest rows: each micro-batch is upserted by key into a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.index import latest


def stream_versions(rows: DataFrame, key: str, version: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's latest row of every key under its batch number; a batch that runs again replaces its own.

    Read the table with ``current``.  Each batch is written to a folder of its number, so retries are idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(table: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over all batches."""
    return latest(table.drop("batch"), key, version)
