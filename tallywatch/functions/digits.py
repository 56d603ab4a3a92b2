"""Leading digits and Benford's law."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Expected share of leading digits 1..9, in percent.
EXPECTED_PCT = [30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6]

# Fixed value: critical value of the chi-square test, 95 %, 8 degrees of freedom.
CHI2_LIMIT = 15.5


def leading_digit(amount: Column) -> Column:
    """First digit of an integer amount, ignoring the sign; null for zero."""
    digit = F.ltrim(amount.cast("string"), F.lit("-")).substr(1, 1).cast("int")
    return F.when(digit > 0, digit)


def hash_digit(binding_hash: Column) -> Column:
    """First character in 1..9 of a hash; null when there is none."""
    digit = F.regexp_extract(binding_hash, "[1-9]", 0)
    return F.when(digit != "", digit.cast("int"))


def benford_deviation(amount: Column) -> Column:
    """Relative gap between the law and the rounded table; 0.5 for amounts <= 0.

    Only nine values exist, so they are looked up, not recomputed per row.
    """
    gaps = []
    for digit, pct in enumerate(EXPECTED_PCT, start=1):
        share = round(pct / 100, 3)
        gaps.append(F.lit(min(1.0, abs(math.log10(1 + 1 / digit) - share) / share)))
    return F.when(amount > 0, F.array(*gaps)[leading_digit(amount) - 1]).otherwise(F.lit(0.5))
