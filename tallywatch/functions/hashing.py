"""Identifier hashes and keyed MACs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_BLOCK = 64


@F.pandas_udf(T.StringType())
def sha3_256_hex(ids: pd.Series) -> pd.Series:
    """SHA3-256 has no Spark built-in; each distinct id of an Arrow batch is hashed once."""
    codes, distinct = pd.factorize(ids)
    digests = [hashlib.sha3_256(value.encode()).hexdigest() for value in distinct]
    return pd.Series(np.array(digests + [None], dtype=object)[codes])


def hash_id(col: Column, alg: str = "sha2") -> Column:
    """Pseudonym of an identifier: native SHA-256, or SHA3-256 over Arrow."""
    if alg == "sha2":
        return F.sha2(col, 256)
    if alg == "sha3":
        return sha3_256_hex(col)
    raise ValueError(f"unknown hash {alg!r}: use sha2 or sha3")


def mac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer key blocks of HMAC-SHA256."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as 64 lower-case hex characters, from native expressions only."""
    inner, outer = mac_pads(key)
    digest = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)
