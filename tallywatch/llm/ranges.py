"""Ascending key ranges of about equal row counts, for global order without one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MOST_RANGES = 4096


def split_points(rows: DataFrame, key: str, rows_per_range: int, most_ranges: int = MOST_RANGES) -> list[int]:
    """Ascending integers; range i holds the keys from point i - 1 (included) up to point i.

    One pass over the key column alone. At most ``most_ranges`` points reach the
    driver; beyond that the ranges grow. An empty table gives no point.
    """
    n = rows.count()
    parts = min(most_ranges, -(-n // rows_per_range))
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    accuracy = F.lit(max(10_000, 20 * parts))
    points = rows.agg(F.percentile_approx(key, at, accuracy)).first()[0] or []
    return sorted(set(points))
