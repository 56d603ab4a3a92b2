"""Stateless checks and windowed aggregates over streams of records.

The aggregates keep their windows in the engine's state, which drops a row later
than ``delay`` without a trace: choose it for the feed, or use ``late``, which
keeps and counts such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timeparts import DAY_NS, event_time
from ..operators.envelope import check_envelopes
from ..operators.privacy import pii_free
from ..sources.ledger import tag_stage


def timed(df: DataFrame, delay: str) -> DataFrame:
    """Add ``ts`` from ``timestamp_ns`` with a watermark."""
    return df.withColumn("ts", event_time(F.col("timestamp_ns"))).withWatermark("ts", delay)


def verify_records(committed: DataFrame) -> DataFrame:
    """Drop records that declare personal data, check the envelope of the rest."""
    return check_envelopes(committed.where(pii_free()))


def check_count_stream(committed: DataFrame, delay: str, window: str = "1 minute") -> DataFrame:
    """Passes and failures per check and window of event time."""
    checked = timed(check_envelopes(committed), delay)
    rows = checked.select("ts", F.explode("checks").alias("c"))
    return rows.groupBy(F.window("ts", window), F.col("c.check").alias("check"), F.col("c.status").alias("status")).agg(
        F.count("*").alias("n")
    )


def live_stats(committed: DataFrame, delay: str, window: str = "1 second") -> DataFrame:
    """Records, quarantined and verified per window of event time."""
    status = F.col("status")
    return timed(committed, delay).groupBy(F.window("ts", window)).agg(
        F.count("*").alias("total"),
        F.count_if(status == "QUARANTINED").alias("quarantined"),
        F.count_if(status == "VERIFIED").alias("verified"),
    )


def velocity_windows(
    txns: DataFrame, delay: str, key: str = "account_hash", window: str = "1 hour", slide: str = "1 minute"
) -> DataFrame:
    """Transactions per account and sliding window: velocity at the grain of the slide."""
    return timed(txns, delay).groupBy(key, F.window("ts", window, slide)).agg(F.count("*").alias("n"))


def ledger_feed(new_rows: DataFrame, after_ns: int | None = None) -> DataFrame:
    """Rows read from the ledger's folder as a stream, tagged with their stage; with a position, only those after it.

    Whole days before the position are not read.
    """
    if after_ns is not None:
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(after_ns // DAY_NS).cast("int"))
        new_rows = new_rows.where((F.col("date_bucket") >= day) & (F.col("timestamp_ns") > after_ns))
    return tag_stage(new_rows)
