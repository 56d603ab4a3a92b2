"""Rates over event time, and ingest delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeparts import NS, floor_div


def per_bucket(df: DataFrame, bucket_s: int = 1, ts: str = "timestamp_ns") -> DataFrame:
    """Rows per time bucket; ``bucket`` is its number since the epoch."""
    return df.groupBy(floor_div(F.col(ts), bucket_s * NS).alias("bucket")).agg(F.count("*").alias("n"))


def sliding_rate(df: DataFrame, window_s: int = 30, slide_s: int = 1, ts: str = "timestamp_ns") -> DataFrame:
    """Events per second over each sliding window that holds an event.

    Rows are counted per slide first; only those counts are repeated once per
    window they fall in.
    """
    if window_s % slide_s:
        raise ValueError("window_s must be a multiple of slide_s")
    spread = per_bucket(df, slide_s, ts).select(
        "n", F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.lit(window_s // slide_s - 1))).alias("bucket")
    )
    return spread.groupBy(((F.col("bucket") + 1) * slide_s).alias("window_end_s")).agg(
        F.sum("n").alias("n"), (F.sum("n") / F.lit(float(window_s))).alias("tps")
    )


def rate_history(
    df: DataFrame, bars: int = 30, bucket_s: int = 1, end_bucket: Column | None = None, ts: str = "timestamp_ns"
) -> DataFrame:
    """The last ``bars`` buckets up to the newest event, empty ones as zero."""
    newest = df.agg(floor_div(F.max(ts), bucket_s * NS).alias("b"))
    end = newest.scalar() if end_bucket is None else end_bucket
    # bounds on the stored time itself, so that files and row groups can be skipped
    first_ns, end_ns = (end - F.lit(bars - 1)) * F.lit(bucket_s * NS), (end + 1) * F.lit(bucket_s * NS)
    recent = per_bucket(df.where((F.col(ts) >= first_ns) & (F.col(ts) < end_ns)), bucket_s, ts)
    spine = newest.select(
        F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"),
        F.coalesce(F.col("b") if end_bucket is None else end_bucket, F.lit(0)).alias("_end"),
    ).withColumn("bucket", F.col("_end") - F.lit(bars - 1) + F.col("bar"))
    label = F.concat(F.lit("-"), (F.lit(bars) - F.col("bar")).cast("string"), F.lit("s"))
    return spine.join(recent, "bucket", "left").select(
        "bar", label.alias("label"), (F.coalesce("n", F.lit(0)) / F.lit(float(bucket_s))).alias("tps")
    )


def rate_summary(history: DataFrame) -> DataFrame:
    """Peak and mean over all bars, padding included."""
    return history.agg(F.round(F.max("tps"), 1).alias("peak"), F.round(F.avg("tps"), 1).alias("avg"))


def lifetime_rate(df: DataFrame, ts: str = "timestamp_ns") -> DataFrame:
    """Records per second, and thousands written per second, over the observed time."""
    elapsed = F.greatest((F.max(ts) - F.min(ts)) / F.lit(float(NS)), F.lit(1.0))
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.count("*") / elapsed, F.lit(0.0)).alias("tps"),
        F.coalesce(F.count("*") / elapsed / 1000, F.lit(0.0)).alias("write_rate_k"),
    )


def ingest_delay(df: DataFrame, event_s: Column, ingest_s: Column, by: Column) -> DataFrame:
    """Delay between event and arrival per period: mean, maximum, and exact median and 95th percentile.

    The percentiles are smallest delays that so large a share does not exceed; they count distinct delays, which
    are combined before the shuffle.
    """
    delay = (ingest_s - event_s).alias("_delay")
    return df.select(by.alias("period"), delay).groupBy("period").agg(
        F.count("_delay").alias("n"),
        F.avg("_delay").alias("avg_delay"),
        F.max("_delay").alias("max_delay"),
        F.expr("cast(percentile_disc(0.5) within group (order by _delay) as bigint)").alias("p50_delay"),
        F.expr("cast(percentile_disc(0.95) within group (order by _delay) as bigint)").alias("p95_delay"),
    )


#: Size parameter of delay sketches, and the share by which a quantile's rank may be off: about 0.9 % at 99 % confidence
#: for this size, doubled here to be safe over many periods.
SKETCH_K, RANK_ERROR = 400, 0.018


def delay_sketches(df: DataFrame, event_s: Column, ingest_s: Column, by: Column, k: int = SKETCH_K) -> DataFrame:
    """period, n, max_delay and a quantile sketch of the delay between event and arrival.

    A sketch holds a few thousand bytes, however many rows or distinct delays a
    period has; tasks make their own and merge them in the shuffle. Rows without a
    delay count in nothing; a period of such rows alone has n 0 and no sketch.
    """
    rows = df.select(by.alias("period"), (ingest_s - event_s).cast("bigint").alias("_delay"))
    return rows.groupBy("period").agg(
        F.count("_delay").alias("n"), F.max("_delay").alias("max_delay"),
        F.when(F.count("_delay") > 0, F.kll_sketch_agg_bigint("_delay", k)).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Column) -> DataFrame:
    """The same for longer periods, from the sketches of the shorter ones alone."""
    held = sketches.where("n > 0").select(by.alias("period"), "n", "max_delay", "sketch")
    return held.groupBy("period").agg(F.sum("n").alias("n"), F.max("max_delay").alias("max_delay"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def with_quantiles(sketches: DataFrame, **shares: float) -> DataFrame:
    """Named quantiles of the sketches, such as ``p95=0.95``; the rank of each is off by ``RANK_ERROR`` at most."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)) for name, share in shares.items()})
