"""Anchors of byte windows: a content-determined place in every window of fixed length.

The anchor of a window is its 32-byte string with the smallest hash, the leftmost
among equals, so equal windows have their anchors at the same offset. Consecutive
windows with one anchor form its *context*: some 35 windows on average, at most
``window - 31``.
"""

from __future__ import annotations

import numpy as np

from .batches import mix64

GRAM = 32


def _pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings twice as long, from the hashes at each place and ``step`` further."""
    n = len(h) - step
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += h[step:] * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(32)
    return out


def contexts(data: np.ndarray, bounds: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Contexts of all rows of bytes: row, start in the row, windows, place of the anchor from the start, and hashes of anchor and context.

    ``anchor`` hashes the 32 bytes; ``context`` all bytes of the context's windows and the anchor's place in it.
    """
    names = ("row", "start", "windows", "offset", "anchor", "context")
    none = {n: np.zeros(0, np.uint64 if n in ("anchor", "context") else np.int64) for n in names}
    if len(data) < window:
        return none
    h = mix64(data.astype(np.uint64) + np.uint64(0x1234567))
    step = 1
    while step < GRAM:
        h = _pairs(h, step)
        step *= 2
    h = mix64(h)
    wide = _pairs(h, GRAM)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    grams = window - GRAM + 1
    least, width = keys, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that would run over the end of their row do not exist
    inside = np.zeros(len(place) + 1, np.int32)
    firsts, lasts = bounds[:-1], bounds[1:] - window
    real = lasts >= firsts
    np.add.at(inside, firsts[real], 1)
    np.add.at(inside, lasts[real] + 1, -1)
    place[np.cumsum(inside[:-1]) == 0] = -1
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], change])
    end = np.concatenate([change, [len(place)]])
    keep = place[first] >= 0
    first, end = first[keep], end[keep]
    if not len(first):
        return none
    anchor_at = place[first]
    length = end - first - 1 + window
    # 64-byte hashes at the start, the end, and where the first one stops cover up to 192 bytes
    context = mix64(wide[first] + (length.astype(np.uint64) << np.uint64(16)) + (anchor_at - first).astype(np.uint64))
    context = mix64(context ^ wide[first + np.minimum(64, length - 64)])
    context = mix64(context + wide[first + length - 64])
    row = np.searchsorted(bounds, first, "right") - 1
    return {"row": row, "start": first - bounds[row], "windows": end - first, "offset": anchor_at - first,
            "anchor": h[anchor_at], "context": context}
