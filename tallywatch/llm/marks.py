"""A bit field of bounded size over document ids, to leave rows out of a shuffle that cannot have a partner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import lean

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_ROW_BITS = 8 * 4096


def marks_of(ids: DataFrame) -> np.ndarray:
    """The field of distinct doc_ids: 16 bits for each, at most 32 MB in all.

    An id always has its bit; others may share it, the more the fuller the field
    is. It is a filter and never the decision.
    """
    n, bits = ids.count(), LEAST_BITS
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    field = np.zeros(bits // 8, np.uint8)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(place.alias("place")).groupBy(F.floor(F.col("place") / _ROW_BITS).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place") % _ROW_BITS).alias("bits")
    )
    for row in rows.toLocalIterator():
        field[row.block * 4096 : (row.block + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return field


def with_place(rows: DataFrame, size: int) -> DataFrame:
    """Rows with, as their last column, the place of their doc_id in a field of ``size`` bytes; null without an id."""
    name = "place"
    while name in rows.columns:
        name += "_"
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(8 * size))
    return rows.withColumn(name, F.when(F.col("doc_id").isNotNull(), place))


def hits(parts: Iterable[pa.RecordBatch], field: np.ndarray, hit: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows whose bit is set, or with ``hit`` false the others, without the place."""
    for part in parts:
        at = part.column(part.num_columns - 1)
        there = np.asarray(at.fill_null(0))
        found = (field[there >> 3] >> (there & 7).astype(np.uint8) & 1).astype(bool) & np.asarray(at.is_valid())
        chosen = part.filter(pa.array(found == hit))
        if chosen.num_rows:
            yield chosen.select(list(range(part.num_columns - 1)))


def marked(rows: DataFrame, field: np.ndarray, hit: bool) -> DataFrame:
    """Rows whose doc_id has its bit set, or with ``hit`` false the others and those without id; all columns stay."""
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def keep(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hits(parts, shared.value, hit)

    return with_place(rows, len(field)).mapInArrow(lean(keep), rows.schema)
