"""Streams: resumable scans, ledgers of what was used, quotas, and event windows.

A scan's place is the checkpoint of its stream; every operator runs with ``availableNow`` and goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables or checkpoints of a stream, in the shared place."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder or pattern, new files as they come."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all rows there are to ``batch`` and stop; a later call with the same checkpoint gives only new rows."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def collect_once(stream: DataFrame, name: str) -> DataFrame:
    """All rows of a stream as a table, exactly once, through a checkpointed file sink."""
    spark = stream.sparkSession
    out, check = folder(spark, name), folder(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ledger_append(ledger: str, key: str) -> Callable[[DataFrame, int], None]:
    """Batch function that adds rows whose key the ledger table doesn't have. A repeated batch adds nothing: its part of the ledger is replaced."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            before = spark.read.option("basePath", ledger).parquet(ledger)
        except AnalysisException:  # the first batch has no ledger yet
            before = None
        if before is not None:
            new = new.join(before.where(F.col("batch") != number).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return run


def windowed_counts(events: DataFrame, size: str, late: str, by: str) -> DataFrame:
    """Tumbling windows of an event stream with a watermark; the same expression serves tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("begins"), by, "n", "value")


def session_counts(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), by, "n")


def quota(stream: DataFrame, cell: str, most: int, order: str) -> DataFrame:
    """The first ``most`` rows of each cell over the life of the stream; within a batch in the order of a column. State is one number per cell."""
    schema = stream.schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        taken = rows.iloc[: max(0, most - used)]
        state.update((used + len(taken),))
        yield taken

    return stream.groupBy(cell).applyInPandasWithState(run, schema, "used bigint", "append", GroupStateTimeout.NoTimeout)
