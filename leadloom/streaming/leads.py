"""Leads as they arrive: first rows by identity within a time, and ledgers kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leadloom.sinks.files import append_csv, latest
from leadloom.sources.csv import _exists


def first_leads(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten ``delay`` behind the latest time, so that the state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def to_ledger(stream: DataFrame, folder: str, columns: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a ledger of CSV files, its rows in order; a resumed run goes on behind the last batch."""
    return stream.writeStream.foreachBatch(lambda rows, _: append_csv(rows, folder, columns, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_master(stream: DataFrame, folder: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the latest row by key. Each batch writes the table anew to a folder of its number, so a batch that is done
    again after a failure gives the same; the highest number is the table."""

    def put(rows: DataFrame, n: int) -> None:
        spark, before = rows.sparkSession, f"{folder}/{n - 1}"
        rows = rows.dropDuplicates([key])
        old = spark.read.parquet(before) if _exists(spark, before) else None
        (latest(old, rows, key) if old is not None else rows).write.mode("overwrite").parquet(f"{folder}/{n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
