"""Ledger lookup and verification of claims by recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import spread_join
from ..schemas import LWE_K, LWE_N, LWE_Q
from .commit import bind


def lookup(ids: DataFrame, ledger: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Ledger record per requested id, with ``found``.

    The ledger is cut down to the wanted ids first. There the ids are the side
    that may be broadcast, so that a few ids do not shuffle the whole ledger.
    """
    wanted = F.lower("txn_id") if ignore_case else F.col("txn_id")
    stored = ledger.withColumnRenamed("txn_id", "ledger_txn_id")
    held = F.lower("ledger_txn_id") if ignore_case else F.col("ledger_txn_id")
    keyed = stored.withColumn("_key", held)
    asked = ids.withColumn("_key", wanted)
    held_rows = keyed.join(asked.select("_key"), "_key", "left_semi")
    joined = spread_join(asked, held_rows, ["_key"], "left").drop("_key")
    return joined.withColumn("found", F.col("ledger_txn_id").isNotNull()).drop("ledger_txn_id")


def verify_claims(claims: DataFrame, ledger: DataFrame, key: bytes, binding: str = "hmac", **options) -> DataFrame:
    """Recompute each claim's binding and compare it with the stored one.

    ``claims`` has (txn_id, amount_cents), ``ledger`` one row per txn_id. Only
    two ledger columns are read. Outcome: VERIFIED, FAILED or NOT_FOUND.
    """
    recomputed = bind(claims.select("txn_id", "amount_cents"), key, binding, **options).select(
        "txn_id", "amount_cents", F.col("binding_hash").alias("recomputed_hash")
    )
    stored = ledger.select("txn_id", F.col("binding_hash").alias("stored_hash"))
    joined = spread_join(recomputed, stored, ["txn_id"], "left")
    outcome = (
        F.when(F.col("stored_hash").isNull(), F.lit("NOT_FOUND"))
        .when(F.col("stored_hash") == F.col("recomputed_hash"), F.lit("VERIFIED"))
        .otherwise(F.lit("FAILED"))
    )
    return joined.withColumns({"outcome": outcome, "verified": outcome == "VERIFIED"})


def reconcile(claims: DataFrame, ledger: DataFrame, key: bytes, binding: str = "hmac", **options) -> DataFrame:
    """Both directions: claim outcomes, plus ledger rows nobody claimed.

    A left join and an anti join instead of a full outer join, whose hot keys
    cannot be split at run time.
    """
    outcomes = verify_claims(claims, ledger, key, binding, **options).select("txn_id", "outcome")
    unclaimed = spread_join(ledger.select("txn_id"), claims.select("txn_id").distinct(), ["txn_id"], "left_anti")
    return outcomes.unionByName(unclaimed.select("txn_id", F.lit("MISSING_CLAIM").alias("outcome")))


# Names of the steps.
STEPS = ["DERIVE_R", "LOAD_MATRIX_A", "COMPUTE_AS_E", "BITWISE_COMPARE", "RESULT"]


def trace(binding: str = "hmac") -> Column:
    """The five verification steps of a found claim; an empty list for NOT_FOUND."""
    done, intact = F.lit("DONE"), F.col("outcome") == "VERIFIED"
    lattice = binding == "lwe"
    details = [
        F.concat(F.lit("nonce from key and "), F.col("txn_id")),
        F.lit(f"{LWE_N * LWE_K} rows modulo {LWE_Q}" if lattice else "no matrix in this binding"),
        F.lit(f"lattice commitment modulo {LWE_Q}" if lattice else "keyed hash of id and amount"),
        F.concat_ws(" / ", F.substring("stored_hash", 1, 16), F.substring("recomputed_hash", 1, 16)),
        F.when(intact, F.lit("bindings agree")).otherwise(F.lit("bindings differ")),
    ]
    states = [done, done if lattice else F.lit("SKIPPED"), done, done, F.when(intact, F.lit("VERIFIED")).otherwise(F.lit("FAILED"))]
    steps = F.array(*[
        F.struct(F.lit(name).alias("step"), detail.alias("detail"), state.alias("status"))
        for name, detail, state in zip(STEPS, details, states)
    ])
    return F.when(F.col("outcome") == "NOT_FOUND", F.slice(steps, 1, 0)).otherwise(steps)


def error_text() -> Column:
    missing = F.concat(F.lit("TXN "), F.col("txn_id"), F.lit(" not found in ledger"))
    return F.when(F.col("outcome") == "NOT_FOUND", missing)
