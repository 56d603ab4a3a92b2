"""Costly columns that are used several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """The same rows; later uses of the column read its value instead of repeating its expression.

    A one-element explode stands between them, which the optimizer does not merge.
    """
    held = df.withColumn(f"_{name}", F.explode(F.array(name)))
    return held.withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
