"""Arrow batches of documents: slicing by size, flat byte views, words as integer codes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty. Other columns, whatever their names, are not read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What an earlier task of this process made under the name, or else made now."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def let_go(but: str | None = None) -> None:
    """Drop what tasks of another kind left in this process; a vocabulary would lie beside the work of all later stages."""
    others = [n for n in _held if n != but]
    for name in others:
        del _held[name]
    if others:
        gc.collect()


def give_back() -> None:
    """Return memory that earlier work of this process has freed to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after whose end its last arrays are given back too: its worker may wait long for the next one."""
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(parts)
        give_back()

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, using: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of text; a longer text stands alone.

    Of what is held in this process only the object named ``using`` stays.
    """
    let_go(using)
    give_back()
    for batch in batches:
        _, bounds = flat_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
    give_back()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 bounds of its rows."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes cut out of one array, without a copy."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)],
    )


def word_spans(
    data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = _WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: first byte, end byte, and bounds of the rows in the word list.

    ``apart`` marks the bytes between words, by default those of ``[^\\x20\\x09-\\x0D]+``.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inner = ~apart[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    starts_of_rows = bounds[:-1][bounds[:-1] < len(data)]
    first[starts_of_rows] = inner[starts_of_rows]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    ends_of_rows = bounds[1:][bounds[1:] > 0] - 1
    last[ends_of_rows] = inner[ends_of_rows]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is far faster than hashing them where many differ."""
    values = np.sort(values, kind="stable")
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: its 8-byte groups mixed in order, then its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    groups = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 8, 8), (1, 1))
    lengths = (ends - starts).astype(np.int64)
    hashes = mix64(lengths.astype(np.uint64) * _ODD)
    masks = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
    alive = np.arange(len(starts))
    at = 0
    with np.errstate(over="ignore"):
        while len(alive):
            pos = starts[alive] + at
            value = groups[pos].copy().view("<u8").ravel() & masks[np.minimum(lengths[alive] - at, 8)]
            hashes[alive] = mix64(hashes[alive] * _ODD2 + value)
            at += 8
            alive = alive[lengths[alive] > at]
    return hashes


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, repeats included, and the bounds of the rows.

    A row with fewer words has one run, all its words; a row without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    row = np.repeat(np.arange(len(n)), n)
    first = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    end = bounds[1:][row]
    hashes = np.full(len(first), 0x5851F42D4C957F2D, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            pos = first + k
            there = pos < end
            value = words[np.minimum(pos, len(words) - 1)]
            hashes = np.where(there, mix64(hashes * _ODD2 + value + np.uint64(k + 1)), hashes)
    return hashes, out_bounds


def distinct_in_rows(values: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the bounds of the rows; row has the row of each value, in any order."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(n_rows + 1))


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for values that lie row after row between the given bounds."""
    return distinct_in_rows(values, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
