"""Normal density and cumulative distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Abramowitz & Stegun 26.2.17.
CDF_P = 0.2316419
CDF_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_density(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return F.exp(F.lit(-0.5) * z * z) / (sigma * F.lit(math.sqrt(2 * math.pi)))


def normal_cdf(z: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(z))
    tail = F.lit(0.0)
    for b in reversed(CDF_B):
        tail = t * (F.lit(b) + tail)
    tail = tail * F.exp(F.lit(-0.5) * z * z) * F.lit(1 / math.sqrt(2 * math.pi))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
