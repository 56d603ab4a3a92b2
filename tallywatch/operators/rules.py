"""Typology rules: each returns (txn_id, rule) for the rows it hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cases import choose
from ..functions.digits import leading_digit
from ..functions.joins import spread_join
from ..functions.timeparts import is_offhours
from ..schemas import CURRENCIES, TXN_TYPES
from .velocity import velocity

# Reporting limits in cents and the usual gap below them.
REPORTING_LIMITS = [100_000_000, 500_000_000, 1_000_000_000]
LIMIT_GAP = 100

# Lowest and highest plausible amount per type, in cents.
AMOUNT_RANGES = {
    "RTGS": (20_000_000, 5_000_000_000),
    "NEFT": (100, 20_000_000),
    "WIRE_TRANSFER": (100_000, 1_000_000_000),
    "TRADE_SETTLEMENT": (1_000_000, 10_000_000_000),
    "INTERNAL_TRANSFER": (100, 50_000_000),
    "FX_CONVERSION": (5_000_000, 100_000_000_000),
}

EXPECTED_NINES = 0.046


def _hits(df: DataFrame, rule: str, condition: Column) -> DataFrame:
    return df.where(condition).select("txn_id", F.lit(rule).alias("rule"))


def structuring(df: DataFrame, limits: list[int] | None = None, gap: int = LIMIT_GAP) -> DataFrame:
    """Amounts just below a reporting limit."""
    amount = F.col("amount_cents")
    below = [(amount >= limit - gap) & (amount < limit) for limit in limits or REPORTING_LIMITS]
    return _hits(df, "STRUCTURING", reduce(lambda a, b: a | b, below))


def unusual_place(df: DataFrame, place: Column, usual_visits: int = 2) -> DataFrame:
    """Off-hours activity at a place the account does not usually use.

    Usual places are counted with a map-side combine; only off-hours rows enter the join.
    """
    located = df.select("txn_id", "account_id", "timestamp_ns", place.alias("_place")).where("_place is not null")
    usual = (
        located.groupBy("account_id", "_place").agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= usual_visits).drop("_n")
    )
    night = located.where(is_offhours(F.col("timestamp_ns")))
    strange = spread_join(night, usual, ["account_id", "_place"], "left_anti")
    return strange.select("txn_id", F.lit("UNUSUAL_PLACE").alias("rule"))


def velocity_burst(df: DataFrame, least: int = 3, window_s: int = 3600) -> DataFrame:
    """Many transactions of one account within the window."""
    slim = df.select("txn_id", "account_id", "timestamp_ns")
    return _hits(velocity(slim, window_s=window_s), "VELOCITY_BURST", F.col("velocity") >= least)


def list_hint(df: DataFrame, key: str = "flag_hint") -> DataFrame:
    """Rows that carry a list hint in their metadata."""
    return _hits(df, "LIST_HINT", F.col("metadata")[key].isNotNull())


def digit_excess(df: DataFrame, digit: int = 9, share: float = 3 * EXPECTED_NINES, least: int = 20) -> DataFrame:
    """Accounts whose amounts start with one digit far too often."""
    first = leading_digit(F.col("amount_cents"))
    counted = df.groupBy("account_id").agg(F.count(first).alias("n"), F.count_if(first == digit).alias("hits"))
    wide = counted.withColumn("share", F.col("hits") / F.col("n"))
    return wide.where((F.col("n") >= least) & (F.col("share") > share))


def out_of_range(df: DataFrame, ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Amounts outside the range of their type; unknown types have none."""
    spans = [(F.col("txn_type") == name, span) for name, span in (ranges or AMOUNT_RANGES).items()]
    low = choose([(is_type, least) for is_type, (least, _) in spans])
    high = choose([(is_type, most) for is_type, (_, most) in spans])
    return _hits(df, "OUT_OF_RANGE", ~F.col("amount_cents").between(low, high))


def validity_problem() -> Column:
    """First broken rule of a row, or null."""
    return (
        F.when(~F.col("txn_type").isin(TXN_TYPES), F.lit("UNKNOWN_TYPE"))
        .when(~F.col("currency").isin(CURRENCIES), F.lit("UNKNOWN_CURRENCY"))
        .when(F.col("counterparty_id") == F.col("account_id"), F.lit("SELF_TRANSFER"))
    )


def invalid(df: DataFrame) -> DataFrame:
    judged = df.withColumn("reject_reason", validity_problem()).where("reject_reason is not null")
    return judged.select("txn_id", F.lit("INVALID").alias("rule"), "reject_reason")


def rule_counts(*hits: DataFrame) -> DataFrame:
    """Hits per rule."""
    merged = reduce(DataFrame.unionByName, [h.select("txn_id", "rule") for h in hits])
    return merged.groupBy("rule").agg(F.count("*").alias("n"))
