"""Signatures of sets for exact similarity joins: segments of the universe with one-deletion neighbourhoods.

Two sets with Jaccard similarity of at least p / q and sizes s <= t differ in at
most H = (s + t)(q - p) / (q + p) elements. Sizes fall into bands; a set is
entered into the band of its size and, as the larger of a pair, into the band
below. A band cuts the universe of elements into m segments by hash. A segment
on which two sets agree is one *unit*; in the first r segments, where contents
with one element deleted are entered too, a difference of one element is found
as well, which counts as two. By the pigeonhole principle a pair agrees on some
entered content if the units come to H + 1.

Contents of fewer than ``least`` elements are shared by many unlike sets and are
left out by rule, on either side alike; m and r give the units to spare. Which
m, r and least a band takes follows from an estimate of cost: rows entered, and
chance meetings in small contents. A set with more small contents than can be
spared enters them as *probes*, which meet the small contents of all others, so
that no pair is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .batches import mix64

PLAIN, PROBE, SMALL = 0, 1, 2
_MEETING = 40.0
_PROBING = 2000.0


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    differ: int
    segments: int
    deletable: int
    least: int


def _poisson(mean: float, k: int) -> float:
    return math.exp(-mean + k * math.log(max(mean, 1e-12)) - math.lgamma(k + 1))


def _tail(mean: float, above: int) -> float:
    """Chance that a Poisson number exceeds ``above``."""
    return max(0.0, 1 - sum(_poisson(mean, k) for k in range(above + 1)))


def _cost(low: int, differ: int, segments: int, deletable: int, least: int) -> float:
    mean = low / segments
    small = sum(_poisson(mean, k) for k in range(least))
    lost = small * (segments + deletable) + _poisson(mean, least) * deletable
    spare = segments + deletable - (differ + 1)
    rows = segments + deletable * mean
    meetings = segments * sum(_poisson(mean, k) * _MEETING / 8**k for k in range(least, 6))
    meetings += deletable * sum(_poisson(mean, k) * k * _MEETING / 8 ** (k - 1) for k in range(least + 1, 6))
    return rows + meetings + _PROBING * _tail(lost, spare)


@lru_cache(maxsize=None)
def band_of(index: int, p: int, q: int) -> Band:
    low = 1 if index == 0 else band_of(index - 1, p, q).high + 1
    high = low * q // p
    differ = (high + high * q // p) * (q - p) // (q + p)
    if differ == 0:
        return Band(low, high, 0, 0, 0, 1)
    best = None
    extra = range(0, 3 + differ // 4 + 8)
    for least in (1, 2, 3):
        for more in extra:
            segments = differ + 1 + more
            for deletable in sorted({0, 1, 2, 4, min(8, segments), segments if segments <= 8 else 1}):
                if deletable > segments:
                    continue
                cost = _cost(low, differ, segments, deletable, least)
                if best is None or cost < best[0]:
                    best = (cost, segments, deletable, least)
    return Band(low, high, differ, *best[1:])


def bands_of(size: int, p: int, q: int) -> list[Band]:
    """Bands up to that of a size."""
    out = [band_of(0, p, q)]
    while out[-1].high < size:
        out.append(band_of(len(out), p, q))
    return out


def _sums(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums of the values of each cell, modulo 2**64."""
    low = np.bincount(cells, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(cells, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return (high << np.uint64(32)) + low


def signatures(elements: np.ndarray, bounds: np.ndarray, p: int, q: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets and the number of the set each belongs to.

    The lowest two bits of a signature tell its kind. Bands
    without room for a difference have none: their sets can only be equal.
    """
    sizes = np.diff(bounds)
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bands = bands_of(int(sizes.max()), p, q)
    highs = np.array([b.high for b in bands])
    own = np.searchsorted(highs, sizes)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix64(elements + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    places = mixed >> np.uint64(33)
    values = mix64(mixed)
    shape = {name: np.array([getattr(b, name) for b in bands]) for name in ("differ", "segments", "deletable", "least")}
    found, owners = [], []
    for below in (0, 1):
        band = own - below
        # the smallest partner of a set decides whether it has to enter the band below
        use = (sizes > 0) & (band >= 0)
        if below:
            use &= highs[np.maximum(band, 0)] * q >= sizes * p
        use &= shape["segments"][np.maximum(band, 0)] > 0
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        band = band[rows]
        segments = shape["segments"][band]
        first = np.concatenate([[0], np.cumsum(segments)])
        number = np.full(len(sizes), -1)
        number[rows] = np.arange(len(rows))
        inside = number[row_of] >= 0
        item_row, item_place, item_value = number[row_of[inside]], places[inside], values[inside]
        segment = (item_place % segments[item_row].astype(np.uint64)).astype(np.int64)
        cells = first[item_row] + segment
        n = int(first[-1])
        count = np.bincount(cells, minlength=n)
        content = _sums(cells, item_value, n)
        cell_row = np.repeat(np.arange(len(rows)), segments)
        cell_segment = np.arange(n) - first[cell_row]
        cell_salt = mix64((band[cell_row].astype(np.uint64) << np.uint64(32)) + cell_segment.astype(np.uint64) + np.uint64(1 + seed * 7919))
        deletable = cell_segment < shape["deletable"][band][cell_row]
        small = count < shape["least"][band][cell_row]
        units = np.bincount(cell_row, ~small + (deletable & (count > shape["least"][band][cell_row])).astype(np.int64), len(rows))
        short = units < shape["differ"][band] + 1
        kind = np.where(small, np.where(short[cell_row], PROBE, SMALL), PLAIN).astype(np.uint64)
        key = mix64(content + cell_salt + (kind > 0).astype(np.uint64))
        found.append((key & ~np.uint64(3)) | kind)
        owners.append(rows[cell_row])
        # deletions: the content without each of its elements in turn
        drop = deletable[cells] & (count[cells] > shape["least"][band][item_row])
        key = mix64(content[cells[drop]] - item_value[drop] + cell_salt[cells[drop]])
        found.append(key & ~np.uint64(3))
        owners.append(rows[item_row[drop]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)
