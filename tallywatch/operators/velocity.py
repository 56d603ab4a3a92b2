"""Transactions per account in the trailing window, exact and safe for hot accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeparts import NS, floor_div


def instant_velocity(
    instants: DataFrame, key: str, ts: str, n: str, window_s: int = 3600, slot_s: int = 1
) -> DataFrame:
    """Trailing count per (key, instant), from one row per instant with its count ``n``.

    Time is cut into slots; the window spans L of them. At an instant in slot s
    the count is
        totals of slots s-L .. s-1
        + instants of slot s up to now
        - instants of slot s-L up to the same offset, which have just expired.
    A slot's instants are also sent, negated, to slot s+L, so one running sum
    per (account, slot) yields the count. No task ever holds more than two
    slots of distinct instants, however many rows an account has.
    """
    if window_s % slot_s:
        raise ValueError("window_s must be a multiple of slot_s")
    span, slots = slot_s * NS, window_s // slot_s
    placed = instants.select(
        key, F.col(ts).alias("_ts"), F.col(n).alias("_n"),
        floor_div(F.col(ts), span).alias("_slot"), F.pmod(F.col(ts), F.lit(span)).alias("_off"),
    )

    # Totals of the L slots before each slot, by the same idea one level up:
    # within a block of L slots the sum starts at the previous block's total,
    # gains the slots passed and loses the previous block's as they expire.
    block = floor_div(F.col("_slot"), slots)
    zero = F.lit(0).cast("bigint")
    own = F.struct(block.alias("block"), F.col("_slot").alias("at"), F.col("_n").alias("delta"), zero.alias("carry"),
                   F.col("_slot").alias("slot"))
    previous = F.struct((block + 1).alias("block"), (F.col("_slot") + F.lit(slots)).alias("at"),
                        (-F.col("_n")).alias("delta"), F.col("_n").alias("carry"), F.lit(None).cast("bigint").alias("slot"))
    totals = placed.groupBy(key, "_slot").agg(F.sum("_n").alias("_n"))
    entries = totals.select(key, F.explode(F.array(own, previous)).alias("_e")).select(key, "_e.*")
    whole = Window.partitionBy(key, "block")
    passed = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    before = (
        entries.withColumn("_prior", F.sum("carry").over(whole) + F.coalesce(F.sum("delta").over(passed), zero))
        .where(F.col("slot").isNotNull() & (F.col("_prior") > 0))
        .select(key, F.col("slot").alias("_slot"), "_prior")
    )

    arrivals = F.struct(F.col("_slot").alias("slot"), F.col("_n").alias("delta"), F.col("_ts").alias("ts"))
    expiries = F.struct(
        (F.col("_slot") + F.lit(slots)).alias("slot"), (-F.col("_n")).alias("delta"),
        F.lit(None).cast("bigint").alias("ts"),
    )
    moves = placed.select(key, "_off", F.explode(F.array(arrivals, expiries)).alias("_m")).select(
        key, F.col("_m.slot").alias("_slot"), "_off", F.col("_m.delta").alias("_delta"), F.col("_m.ts").alias("_ts")
    )
    opening = before.select(
        key, "_slot", F.lit(-1).cast("bigint").alias("_off"), F.col("_prior").alias("_delta"),
        F.lit(None).cast("bigint").alias("_ts"),
    )
    running = (
        Window.partitionBy(key, "_slot").orderBy("_off").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        moves.unionByName(opening)
        .withColumn("_count", F.sum("_delta").over(running))
        .where(F.col("_ts").isNotNull())
        .select(key, F.col("_ts").alias(ts), F.col("_count").alias("velocity"))
    )


def velocity(
    df: DataFrame,
    key: str = "account_id",
    ts: str = "timestamp_ns",
    window_s: int = 3600,
    slot_s: int = 1,
    out: str = "velocity",
    of: DataFrame | None = None,
) -> DataFrame:
    """Add the number of the key's rows in (t - window, t], the current row included.

    All rows of ``df`` are counted; the counts are given to ``of``, some rows of
    ``df``, or to all of them.

    Rows at the same instant count each other. Rows collapse to instants before
    the first shuffle; the counts return by a join on (key, instant). A null
    key has no count.
    """
    instants = df.where(F.col(key).isNotNull()).groupBy(key, ts).agg(F.count("*").alias("_n"))
    counts = instant_velocity(instants, key, ts, "_n", window_s, slot_s)
    rows = df if of is None else of
    return rows.join(counts.withColumnRenamed("velocity", out), [key, ts], "left").select(*rows.columns, out)
