"""Score distribution, density curve, outlier percentiles, size histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normal import normal_cdf, normal_density

# Centre and spread shown before any score has arrived, least spread.
EMPTY_MU, EMPTY_SIGMA, MIN_SIGMA = 0.12, 0.08, 0.001


def score_stats(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """One row: n, mu, sigma (sample, floored) and the peak of the fitted density."""
    base = df.agg(
        F.count(score).alias("n"),
        F.coalesce(F.avg(score), F.lit(EMPTY_MU)).alias("mu"),
        F.when(F.count(score) == 0, F.lit(EMPTY_SIGMA))
        .otherwise(F.greatest(F.coalesce(F.stddev_samp(score), F.lit(0.0)), F.lit(MIN_SIGMA))).alias("sigma"),
    )
    peak = normal_density(F.col("mu"), F.col("mu"), F.col("sigma"))
    return base.withColumn("peak", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(peak))


def density_curve(df: DataFrame, score: str = "anomaly_score", points: int = 200) -> DataFrame:
    """``points`` samples of the fitted density within four sigma and 0..1; none without scores."""
    stats = score_stats(df, score).where("n > 0")
    low = F.greatest(F.lit(0.0), F.col("mu") - 4 * F.col("sigma"))
    high = F.least(F.lit(1.0), F.col("mu") + 4 * F.col("sigma"))
    x = low + (high - low) * F.col("i") / F.lit(float(points - 1))
    return stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        "i", x.alias("x"), normal_density(x, F.col("mu"), F.col("sigma")).alias("y")
    )


def percentile_label(pct: Column) -> Column:
    """One decimal, half up on the two decimals shown."""
    return F.concat(F.round(pct.cast("decimal(5,2)"), 1).cast("string"), F.lit("th"))


def outlier_percentiles(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Place of every scored row in the fitted normal distribution.

    The two statistics come as a scalar subquery: one value, no join.
    """
    stats = score_stats(df, score).select(F.struct("mu", "sigma")).scalar()
    placed = df.where(F.col(score).isNotNull()).withColumn("_s", stats)
    x, mu, sigma = F.col(score), F.col("_s.mu"), F.col("_s.sigma")
    return placed.withColumns({
        "percentile": F.round(normal_cdf((x - mu) / sigma) * 100, 2),
        "density": F.greatest(normal_density(x, mu, sigma), F.lit(1e-9)),
    }).drop("_s")


def size_histogram(df: DataFrame, size_kb: str = "size_kb") -> DataFrame:
    """Rows per half-kilobyte bucket (ties to even), for sizes above zero."""
    bucket = F.rint(F.col(size_kb) * 2) / 2
    return df.where(F.col(size_kb) > 0).groupBy(bucket.alias("bucket_kb")).agg(F.count("*").alias("n"))


def size_summary(df: DataFrame, size_kb: str = "size_kb") -> DataFrame:
    """Number and mean of sizes above zero."""
    return df.where(F.col(size_kb) > 0).agg(
        F.count("*").alias("total_records"),
        F.round(F.coalesce(F.avg(size_kb), F.lit(0.0)), 2).alias("avg_kb"),
    )
