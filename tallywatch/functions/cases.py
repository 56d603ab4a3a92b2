"""CASE expressions from pairs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def choose(pairs: Iterable[tuple[Column, object]], default: Column | None = None) -> Column:
    """Value of the first pair whose condition holds, else the default (null when not given)."""
    (first, value), *rest = pairs
    lead = F.when(first, F.lit(value))
    chain = reduce(lambda acc, pair: acc.when(pair[0], F.lit(pair[1])), rest, lead)
    return chain if default is None else chain.otherwise(default)
