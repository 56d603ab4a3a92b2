"""Ledger totals, batch summaries and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.ratios import percent
from ..functions.timeparts import NS
from .throughput import lifetime_rate


def status_stats(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per state and the share verified, in percent with one decimal."""
    def state(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    counted = ledger.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), state("VERIFIED").alias("verified"), state("QUARANTINED").alias("quarantined"),
        state("REJECTED").alias("rejected"), state("PENDING").alias("pending"),
    )
    return counted.withColumn("chain_integrity_pct", percent(F.col("verified"), F.col("total"), 1))


def overview(ledger: DataFrame, checked: DataFrame) -> DataFrame:
    """One row of figures: ledger totals, lifetime rate, and outcomes of the signature and data checks."""
    passed = F.filter("checks", lambda c: c["status"] == "PASS")["check"]
    failed = F.filter("checks", lambda c: c["status"] == "FAIL")["check"]
    checks = checked.select(passed.alias("passed"), failed.alias("failed")).agg(F.struct(
        F.count_if(F.array_contains("passed", "SIGNATURE")).alias("signature_verified"),
        F.count_if(F.array_contains("failed", "SIGNATURE")).alias("signature_failed"),
        F.count_if(F.array_contains("failed", "PII_ASSERTION")).alias("pii_failed"),
    )).scalar()
    totals = status_stats(ledger).withColumn("_c", checks)
    rate = lifetime_rate(ledger).select("tps").scalar()
    return totals.select(
        rate.alias("tps"), F.col("total").alias("total_commitments"), "verified", "quarantined", "rejected",
        "chain_integrity_pct", "_c.signature_verified", "_c.signature_failed", "_c.pii_failed",
    )


def batch_summary(results: DataFrame, ts: str = "timestamp_ns") -> DataFrame:
    """One row per ``batch_id`` over results with a ``status``; time is the span of event time."""
    counted = results.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "VERIFIED").alias("committed"),
        F.count_if(F.col("status") == "QUARANTINED").alias("quarantined"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        (F.max(ts) - F.min(ts)).alias("_span"),
    )
    return counted.select(
        "batch_id", "total", "committed", "quarantined", "rejected",
        (F.col("_span") / F.lit(1e6)).alias("processing_time_ms"),
        (F.col("total") / F.greatest(F.col("_span") / F.lit(float(NS)), F.lit(1.0))).alias("tps"),
        percent(F.col("committed"), F.col("total"), 1).alias("chain_integrity_pct"),
    )


def ingest_counts(judged: DataFrame) -> DataFrame:
    """Processed rows, errors and signature failures, from rows with a ``reject_reason``."""
    reason = F.col("reject_reason")
    return judged.agg(
        F.count_if(reason.isNull()).alias("processed"),
        F.count_if(reason.isNotNull() & (reason != "BAD_SIGNATURE")).alias("errors"),
        F.count_if(reason == "BAD_SIGNATURE").alias("signature_failures"),
    )


def observe_ingest(judged: DataFrame, observation: Observation | str) -> DataFrame:
    """The same counters gathered on the side while the rows flow on, in batch or stream."""
    reason = F.col("reject_reason")
    return judged.observe(
        observation,
        F.count_if(reason.isNull()).alias("processed"),
        F.count_if(reason.isNotNull() & (reason != "BAD_SIGNATURE")).alias("errors"),
        F.count_if(reason == "BAD_SIGNATURE").alias("signature_failures"),
    )
