"""Windowed counts over a stream that lose no row: what comes too late, too early or without time is set aside.

A micro-batch adds its partial sums as files, replaced as a whole when it is
retried; totals are summed on read. So a window may grow at any time, no state
sits in an executor, and ``aside`` has every row that no window counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeparts import NS
from .sinks import parquet_sink


def time_problem(mark: int | None, delay_s: int, latest_ns: Column | None) -> Column:
    """Why a row's time is not taken: NO_TIME, FUTURE (after ``latest_ns``), LATE (over ``delay_s`` before the mark); else null."""
    ns = F.col("timestamp_ns")
    problem = F.when(ns.isNull(), F.lit("NO_TIME"))
    if latest_ns is not None:
        problem = problem.when(ns > latest_ns, F.lit("FUTURE"))
    if mark is not None:
        problem = problem.when(ns < F.lit(mark - delay_s * NS), F.lit("LATE"))
    return problem.otherwise(F.lit(None).cast("string"))


def newest_time(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The greatest accepted time up to and including a batch."""
    if batch_id < 0:
        return None
    return spark.read.parquet(f"{out}/marks/batch_id={batch_id}").first()["mark"]


def keep_newest(spark: SparkSession, out: str, batch_id: int, mark: int | None) -> None:
    row = spark.createDataFrame([(mark,)], "mark bigint")
    row.write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")


def window_batch(out: str, aggregate: Callable[[DataFrame], DataFrame], delay_s: int, latest_ns: Column | None = None) -> Callable:
    """Function for ``foreachBatch``: partial sums to ``out``/windows, other rows with their reason to ``out``/aside."""
    write = parquet_sink(out)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_time(spark, out, batch_id - 1)
        rows = batch.withColumn("aside_reason", time_problem(before, delay_s, latest_ns)).persist()
        try:
            fresh = rows.where("aside_reason is null").drop("aside_reason")
            aside = rows.where("aside_reason is not null")
            write("windows", aggregate(fresh), batch_id)
            write("aside", aside, batch_id)
            write("aside_counts", aside.groupBy("aside_reason").agg(F.count("*").alias("n")), batch_id)
            top = fresh.agg(F.max("timestamp_ns")).first()[0]
        finally:
            rows.unpersist()
        keep_newest(spark, out, batch_id, max((m for m in (before, top) if m is not None), default=None))

    return run


def window_stream(rows: DataFrame, out: str, checkpoint: str, aggregate: Callable[[DataFrame], DataFrame], delay_s: int,
                  latest_ns: Column | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Count a stream into ``out``; ``aggregate`` turns accepted rows into keys and sums."""
    run = window_batch(out, aggregate, delay_s, latest_ns)
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_windows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Totals of all batches so far."""
    parts = spark.read.parquet(f"{out}/windows").drop("batch_id")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def read_aside(spark: SparkSession, out: str) -> DataFrame:
    """Rows no window counts, with ``aside_reason``."""
    return spark.read.parquet(f"{out}/aside")
