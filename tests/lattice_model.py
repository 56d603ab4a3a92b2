"""Slow model of the lattice commitment, straight from its definition."""

import hashlib
import hmac

N, K, Q = 256, 2, 3329


def small(seed, nonce):
    stream = hashlib.shake_256(seed + bytes([nonce, 0])).digest(512)
    return [(b & 15).bit_count() - (b >> 4).bit_count() for b in stream[:N]]


def uniform(seed, i, j):
    s = hashlib.shake_128(seed + bytes([i, j])).digest(3 * N)
    words = [int.from_bytes(s[p:p + 2], "little") & 0x1FFF for p in range(0, len(s) - 2, 3)]
    kept = [w for w in words if w < Q]
    return kept + [0] * (N - len(kept))


def times(a, b):
    full = [0] * (2 * N)
    for i, x in enumerate(a):
        if x:
            for j, y in enumerate(b):
                full[i + j] += x * y
    return [full[i] - full[i + N] for i in range(N)]


def plus(*polys):
    return [sum(c) for c in zip(*polys)]


def commit(seed, key, txn_id, amount, bits):
    a = [[uniform(seed, i, j) for j in range(K)] for i in range(K)]
    s = [small(seed, i) for i in range(K)]
    t0 = plus(times(a[0][0], s[0]), times(a[0][1], s[1]), small(seed, K))
    r_seed = hmac.new(key, txn_id.encode(), hashlib.sha256).digest()
    r = [small(r_seed, i) for i in range(K)]
    u = [plus(times(a[0][i], r[0]), times(a[1][i], r[1]), small(r_seed, K + i)) for i in range(K)]
    m = [(amount >> i & 1) * 1664 if i < bits else 0 for i in range(N)]
    v = plus(times(t0, r[0]), small(r_seed, 2 * K), m)
    return b"".join((c % Q).to_bytes(2, "little") for poly in (*u, v) for c in poly)
