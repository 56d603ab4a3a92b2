"""Module-LWE commitment kernel for Arrow batches.

With fixed public values both parts of a commitment are linear in the small
vector drawn per transaction, so a whole batch is one matrix product. Products
stay below 2**24 and are exact in float32. Consistency check only; no security
claim is made.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from ..schemas import LWE_K, LWE_N, LWE_Q

PAYLOAD_BYTES = 2 * (LWE_K + 1) * LWE_N

_BALANCE = np.array([bin(b & 15).count("1") - bin(b >> 4).count("1") for b in range(256)], dtype=np.int8)


def small_polys(seeds: list[bytes], count: int) -> np.ndarray:
    """Centred binomial coefficients, ``count`` polynomials per seed in one row each.

    A coefficient is the bits of a byte's low nibble minus those of its high one.
    """
    suffixes = [nonce.to_bytes(2, "little") for nonce in range(count)]
    stream = b"".join(hashlib.shake_256(seed + s).digest(LWE_N) for seed in seeds for s in suffixes)
    taken = np.frombuffer(stream, dtype=np.uint8).reshape(len(seeds), count * LWE_N)
    return _BALANCE[taken]


def uniform_poly(seed: bytes, row: int, col: int) -> np.ndarray:
    """13-bit words from every third byte, kept when below q, zero-padded."""
    stream = np.frombuffer(hashlib.shake_128(seed + bytes([row, col])).digest(3 * LWE_N), dtype=np.uint8)
    words = (stream[0::3].astype(np.int64) + 256 * stream[1::3].astype(np.int64)) % 8192
    kept = words[words < LWE_Q]
    return np.pad(kept, (0, LWE_N - len(kept)))


def multiplier(poly: np.ndarray) -> np.ndarray:
    """Matrix of multiplication by ``poly`` modulo x**N + 1."""
    power = np.arange(LWE_N)
    gap = power[:, None] - power[None, :]
    return np.where(gap >= 0, poly[gap % LWE_N], -poly[gap % LWE_N])


def public_matrix(seed: bytes) -> np.ndarray:
    """Stack u = A^T r and v = t0 r0 into one (3N x 2N) matrix, entries centred mod q."""
    a = [[uniform_poly(seed, i, j) for j in range(LWE_K)] for i in range(LWE_K)]
    small = small_polys([seed], 2 * LWE_K).reshape(2 * LWE_K, LWE_N).astype(np.int64)
    t0 = small[LWE_K] + sum(multiplier(a[0][j]) @ small[j] for j in range(LWE_K))
    blocks = [[multiplier(a[j][i]) for j in range(LWE_K)] for i in range(LWE_K)]
    blocks.append([multiplier(t0 % LWE_Q)] + [np.zeros((LWE_N, LWE_N), dtype=np.int64)] * (LWE_K - 1))
    stacked = np.block(blocks) % LWE_Q
    return np.where(stacked > LWE_Q // 2, stacked - LWE_Q, stacked).astype(np.float32)


def commit_batch(matrix: np.ndarray, nonces: list[bytes], amounts: np.ndarray, bits: int) -> np.ndarray:
    """Payload coefficients (n x 3N, uint16) for n transactions."""
    draws = small_polys(nonces, 2 * LWE_K + 1)
    width = LWE_K * LWE_N
    out = draws[:, :width].astype(np.float32) @ matrix.T
    out += draws[:, width:]
    message = (amounts[:, None] >> np.arange(bits)) & 1
    out[:, width:width + bits] += message * (LWE_Q // 2)
    return (out.astype(np.int32) % LWE_Q).astype("<u2")


def commit_batches(
    batches: Iterator[pd.DataFrame], matrix: np.ndarray, bits: int, chunk: int = 1024
) -> Iterator[pd.DataFrame]:
    """Add payload and binding hash to batches that carry ``nonce_hex`` and ``amount_cents``."""
    for batch in batches:
        for start in range(0, len(batch), chunk):
            part = batch.iloc[start:start + chunk]
            nonces = [bytes.fromhex(h) for h in part["nonce_hex"]]
            amounts = part["amount_cents"].to_numpy(dtype=np.int64)
            payloads = [row.tobytes() for row in commit_batch(matrix, nonces, amounts, bits)]
            yield part.drop(columns=["nonce_hex"]).assign(
                commitment_b64=[base64.b64encode(p).decode() for p in payloads],
                binding_hash=[hashlib.sha3_256(p).hexdigest() for p in payloads],
            )
