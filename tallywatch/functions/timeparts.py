"""UTC calendar parts straight from epoch nanoseconds.

Integer arithmetic only, so results do not depend on the session time zone
and stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NS = 1_000_000_000
HOUR_NS = 3600 * NS
DAY_NS = 24 * HOUR_NS


def floor_div(col: Column, divisor: int) -> Column:
    """Integer division rounding towards minus infinity."""
    return F.call_function("div", col - F.pmod(col, F.lit(divisor)), F.lit(divisor))


def hour_of_day(ns: Column) -> Column:
    return floor_div(F.pmod(ns, F.lit(DAY_NS)), HOUR_NS).cast("int")


def weekday(ns: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(floor_div(ns, DAY_NS) + F.lit(3), F.lit(7)).cast("int")


def date_bucket(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, DAY_NS).cast("int"))


def event_time(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def is_offhours(ns: Column) -> Column:
    hour = hour_of_day(ns)
    return (hour < 6) | (hour > 22)


def is_weekend(ns: Column) -> Column:
    return weekday(ns) >= 5
