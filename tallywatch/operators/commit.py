"""Bulk commitments to transaction amounts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hash_id, hmac_sha256
from ..functions.lattice import PAYLOAD_BYTES, commit_batches, public_matrix
from ..functions.risk import status_of
from ..schemas import DEFAULT_THRESHOLD, LEDGER_COLS, LWE_ETA, LWE_K, LWE_N, LWE_Q, TXN_TYPES


def keyed_nonce(key: bytes, txn_id: Column) -> Column:
    """Per-transaction randomness: HMAC-SHA256(key, txn_id)."""
    return hmac_sha256(key, txn_id)


def mac_binding(key: bytes, txn_id: Column, amount: Column) -> Column:
    return hmac_sha256(key, F.concat_ws("|", txn_id, amount.cast("string")))


def declared_params() -> Column:
    values = {"n": LWE_N, "k": LWE_K, "q": LWE_Q, "eta": LWE_ETA}
    return F.struct(*[F.lit(v).alias(name) for name, v in values.items()])


@lru_cache(maxsize=4)
def _matrix(seed: bytes):
    return public_matrix(seed)


def bind(df: DataFrame, key: bytes, binding: str = "hmac", seed: bytes = bytes(32), bits: int = 64) -> DataFrame:
    """Add ``commitment_b64``, ``binding_hash`` and ``size_kb`` from (txn_id, amount_cents).

    ``hmac`` is native. ``lwe`` builds the public matrix once per Python worker
    and multiplies whole Arrow batches; ``bits=32`` encodes only the low half
    of the amount. That costs far more than moving the narrow rows, so they are
    dealt out evenly first. Filter before: predicates do not pass the Arrow stage.
    A null amount has no binding.
    """
    if binding == "hmac":
        digest = F.when(F.col("amount_cents").isNotNull(), mac_binding(key, F.col("txn_id"), F.col("amount_cents")))
        return df.withColumn("binding_hash", digest).withColumns({
            "commitment_b64": F.base64(F.unhex("binding_hash")),
            "size_kb": F.lit(32 / 1024),
        })
    if binding != "lwe":
        raise ValueError(f"unknown binding {binding!r}: use hmac or lwe")

    def run(batches):
        yield from commit_batches(batches, _matrix(seed), bits)

    schema = T.StructType(df.schema.fields + [
        T.StructField("commitment_b64", T.StringType()), T.StructField("binding_hash", T.StringType())
    ])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a null would turn the batch's amounts into floats
    known = df.where(F.col("amount_cents").isNotNull() & F.col("txn_id").isNotNull())
    keyed = known.repartition(tasks).withColumn("nonce_hex", keyed_nonce(key, F.col("txn_id")))
    none = F.lit(None).cast("string")
    rest = df.where(F.col("amount_cents").isNull() | F.col("txn_id").isNull()).withColumns(
        {"commitment_b64": none, "binding_hash": none})
    return keyed.mapInPandas(run, schema).unionByName(rest).withColumn("size_kb", F.lit(round(PAYLOAD_BYTES / 1024, 1)))


def commit_table(
    txns: DataFrame,
    key: bytes,
    binding: str = "hmac",
    alg: str = "sha2",
    threshold: float = DEFAULT_THRESHOLD,
    seed: bytes = bytes(32),
    bits: int = 64,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Ledger rows for normalised transactions; no raw id or amount survives, other columns only if named in ``keep``."""
    slim = txns.select("txn_id", "amount_cents", "account_id", "txn_type", "timestamp_ns", "anomaly_score", *keep)
    hashed = slim.withColumn("account_hash", hash_id(F.col("account_id"), alg)).drop("account_id")
    bound = bind(hashed, key, binding, seed, bits).withColumns({
        "lwe_params": declared_params(),
        "pii_bytes": F.lit(0),
        "status": status_of(F.col("anomaly_score"), threshold),
    })
    return bound.select(*LEDGER_COLS, *keep)


def commit_problem() -> Column:
    """Why a row cannot be committed; null when it can."""
    return (
        F.when(F.col("txn_id").isNull() | (F.col("txn_id") == ""), F.lit("MISSING_TXN_ID"))
        .when(F.col("amount_cents").isNull(), F.lit("MISSING_AMOUNT"))
        .when(F.col("account_id").isNull(), F.lit("MISSING_ACCOUNT"))
        .when(F.col("txn_type").isNull() | ~F.col("txn_type").isin(TXN_TYPES), F.lit("UNKNOWN_TYPE"))
        .when(F.col("anomaly_score").isNull() | F.isnan("anomaly_score"), F.lit("MISSING_SCORE"))
    )


def commit_batch(txns: DataFrame, key: bytes, **options) -> tuple[DataFrame, DataFrame]:
    """Committed rows, and rows set aside with a reason; one bad row stops nothing."""
    judged = txns.withColumn("reject_reason", commit_problem())
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return commit_table(good, key, **options), judged.where(F.col("reject_reason").isNotNull())
