"""Leading-digit tables, whole or per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digits import CHI2_LIMIT, EXPECTED_PCT
from ..functions.ratios import percent


def digit_counts(df: DataFrame, digit: Column) -> DataFrame:
    """Rows per leading digit; rows without one are skipped."""
    return df.select(digit.alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))


def _tallied(df: DataFrame, digit: Column, by: list[str]) -> DataFrame:
    rows = df.select(*by, digit.alias("_d"))
    return rows.groupBy(*by).agg(
        F.count("_d").alias("sample_count"),
        *[F.count_if(F.col("_d") == d).alias(f"_c{d}") for d in range(1, 10)],
    )


def _chi2(tallied: DataFrame) -> DataFrame:
    """Statistics over rounded percentages, and over the counts themselves."""
    total = F.col("sample_count")
    by_pct, by_count = [], []
    for d, pct in enumerate(EXPECTED_PCT, start=1):
        gap = percent(F.col(f"_c{d}"), total, 2) - F.lit(pct)
        by_pct.append(gap * gap / F.lit(pct))
        want = total * F.lit(pct / 100)
        by_count.append((F.col(f"_c{d}") - want) * (F.col(f"_c{d}") - want) / want)

    def add(terms: list[Column]) -> Column:
        return F.when(total > 0, reduce(lambda a, b: a + b, terms)).otherwise(F.lit(0.0))

    raw = add(by_pct)
    return tallied.withColumns({
        "chi2_statistic": F.round(raw, 3),
        "deviation_flag": raw > F.lit(CHI2_LIMIT),
        "chi2_counts": add(by_count),
    })


def benford_summary(df: DataFrame, digit: Column, by: list[str] | None = None) -> DataFrame:
    """One row per group: sample size, chi-square and flag."""
    keys = by or []
    return _chi2(_tallied(df, digit, keys)).select(
        *keys, "sample_count", "chi2_statistic", "deviation_flag", "chi2_counts"
    )


def benford_table(df: DataFrame, digit: Column, by: list[str] | None = None) -> DataFrame:
    """Nine rows per group: expected and observed percent, with the group's chi-square.

    Nine conditional counts per group and an explode: one shuffle, no digit
    spine to join.
    """
    keys = by or []
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("digit"), F.lit(pct).alias("expected_pct"),
            percent(F.col(f"_c{d}"), F.col("sample_count"), 2).alias("observed_pct"), F.col(f"_c{d}").alias("n"),
        )
        for d, pct in enumerate(EXPECTED_PCT, start=1)
    ])
    stats = _chi2(_tallied(df, digit, keys))
    return stats.select(
        *keys, F.explode(rows).alias("r"), "sample_count", "chi2_statistic", "deviation_flag", "chi2_counts"
    ).select(*keys, "r.*", "sample_count", "chi2_statistic", "deviation_flag", "chi2_counts")
