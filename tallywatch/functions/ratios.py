"""Rounded percentages from integer counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole rounded half up, in integer arithmetic; 0.0 when whole is 0.

    Exact, so it does not depend on how an engine rounds binary fractions.
    """
    scale = 10 ** digits
    rounded = F.call_function("div", part * F.lit(200 * scale) + whole, whole * F.lit(2))
    return F.when(whole > 0, rounded / F.lit(float(scale))).otherwise(F.lit(0.0))
