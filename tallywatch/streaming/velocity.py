"""Exact trailing counts per account over a stream, equal to the batch operator.

Arrivals are kept in a folder by six-hour chunk and batch, sorted by time. Each micro-batch emits the
rows the watermark has passed, counted by the batch operator over them and one
window before. So a hot account is split like in batch, nothing lives in
executor memory between batches, and a retried batch rewrites the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeparts import HOUR_NS, NS, floor_div
from ..operators.velocity import velocity
from .late import keep_newest, newest_time, time_problem
from .sinks import parquet_sink


CHUNK_NS = 6 * HOUR_NS


def _history(spark: SparkSession, out: str, low: int, high: int) -> DataFrame:
    """Arrivals with low <= timestamp_ns < high; the chunk column prunes the folders read."""
    rows = spark.read.parquet(f"{out}/history")
    rows = rows.where(F.col("chunk").between(low // CHUNK_NS, high // CHUNK_NS)).drop("chunk", "batch_id")
    return rows.where((F.col("timestamp_ns") >= low) & (F.col("timestamp_ns") < high))


def _emit(spark: SparkSession, out: str, key: str, window_s: int, low: int, high: int) -> DataFrame:
    """Counted rows with low <= timestamp_ns < high."""
    seen = _history(spark, out, low - window_s * NS, high)
    return velocity(seen, key=key, window_s=window_s).where(F.col("timestamp_ns") >= low)


def velocity_batch(out: str, delay_s: int, key: str = "account_hash", window_s: int = 3600,
                   latest_ns: Column | None = None) -> Callable:
    """Function for ``foreachBatch``.

    The watermark lies ``delay_s`` before the newest time accepted so far. Rows
    older than it, rows without time, and rows after ``latest_ns``, which would
    move it for good, go to ``out``/aside with their reason.
    """
    write = parquet_sink(out)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_time(spark, out, batch_id - 1)
        mark = None if before is None else before - delay_s * NS
        rows = batch.withColumn("aside_reason", time_problem(before, delay_s, latest_ns)).persist()
        try:
            taken = rows.where("aside_reason is null").drop("aside_reason")
            span = taken.agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high")).first()
            write("aside", rows.where("aside_reason is not null"), batch_id)
            if span["high"] is not None:
                fresh = taken.withColumns({
                    "chunk": floor_div(F.col("timestamp_ns"), CHUNK_NS), "batch_id": F.lit(batch_id)
                })
                spread = fresh.hint("rebalance", "chunk").sortWithinPartitions("chunk", "timestamp_ns")
                (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("chunk", "batch_id").parquet(f"{out}/history"))
        finally:
            rows.unpersist()
        newest = max((m for m in (span["high"], before) if m is not None), default=None)
        if newest is not None:
            low = span["low"] if mark is None else mark
            new_mark = newest - delay_s * NS
            if new_mark > low:
                write("velocity", _emit(spark, out, key, window_s, low, new_mark), batch_id)
        keep_newest(spark, out, batch_id, newest)

    return run


def velocity_stream(
    txns: DataFrame,
    out: str,
    checkpoint: str,
    delay_s: int,
    key: str = "account_hash",
    window_s: int = 3600,
    latest_ns: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each row with its trailing count to ``out``/velocity once the watermark passed it."""
    run = velocity_batch(out, delay_s, key, window_s, latest_ns)
    writer = txns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def pending_velocity(spark: SparkSession, out: str, last_batch: int, delay_s: int, key: str = "account_hash",
                     window_s: int = 3600) -> DataFrame:
    """Counts of the rows the watermark has not passed yet, as they stand."""
    newest = newest_time(spark, out, last_batch)
    return _emit(spark, out, key, window_s, newest - delay_s * NS, newest + 1)
