"""Recent records and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.risk import severity_of, severity_rank


def newest(df: DataFrame, n: int) -> DataFrame:
    """The n newest rows, newest first."""
    return df.orderBy(F.col("timestamp_ns").desc(), F.col("txn_id").desc()).limit(n)


def oldest(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, oldest first."""
    return df.orderBy("timestamp_ns", "txn_id").limit(n)


def last_per_topic(df: DataFrame, topics: list[str], n: int = 500) -> DataFrame:
    """The n newest rows of each topic, numbered.

    Each topic is a distributed top-n that keeps n rows per task; only those
    winners are numbered.
    """
    newest_first = Window.partitionBy("topic").orderBy(F.col("timestamp_ns").desc(), F.col("txn_id").desc())
    winners = reduce(DataFrame.unionByName, [newest(df.where(F.col("topic") == t), n) for t in topics])
    return winners.withColumn("rank", F.row_number().over(newest_first))


def alert_feed(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The n newest anomalies as alerts, most severe first."""
    severity = severity_of(F.coalesce("anomaly_score", F.lit(0.0)))
    flag = F.coalesce("flag_reason", F.lit("HIGH_ANOMALY_SCORE"))
    chosen = newest(anomalies, n).withColumn("severity", severity)
    ranked = chosen.orderBy(severity_rank(F.col("severity")), F.col("timestamp_ns").desc(), F.col("txn_id"))
    return ranked.select(
        "txn_id", "severity", F.concat(flag, F.lit(": "), F.right("txn_id", F.lit(12))).alias("message"),
        "timestamp_ns", "anomaly_score",
    )
