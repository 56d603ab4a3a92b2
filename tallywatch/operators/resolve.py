"""Review decisions applied to the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cases import choose
from ..functions.joins import spread_join

# Review actions and the state they lead to.
ACTIONS = {"AUTHORIZE": "VERIFIED", "TERMINATE": "REJECTED", "QUARANTINE": "QUARANTINED"}


def resolve(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """Ledger with the last valid action per transaction applied.

    ``actions`` has (txn_id, action, resolved_by, action_seq). The latest is an
    aggregate, so many actions on one transaction combine before the shuffle.
    """
    valid = actions.where(F.col("action").isin(*ACTIONS))
    last = valid.groupBy("txn_id").agg(
        F.max(F.struct("action_seq", "action", "resolved_by")).alias("last")
    ).select("txn_id", F.col("last.action").alias("action"), F.col("last.resolved_by").alias("resolved_by"))
    decided = choose([(F.col("action") == action, status) for action, status in ACTIONS.items()], F.col("status_before"))
    joined = ledger.join(last, "txn_id", "left").withColumnRenamed("status", "status_before")
    return joined.withColumn("status", decided)


def resolve_errors(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """Refused actions: 400 for an unknown action, 404 for an unknown transaction."""
    known = F.col("action").isin(*ACTIONS)
    bad = actions.where(~F.coalesce(known, F.lit(False))).select(
        "txn_id", "action", F.lit(400).alias("code"),
        F.concat(F.lit("Unknown action: "), F.coalesce("action", F.lit("None"))).alias("detail"),
    )
    lost = spread_join(actions.where(known), ledger.select("txn_id"), ["txn_id"], "left_anti").select(
        "txn_id", "action", F.lit(404).alias("code"),
        F.concat(F.lit("TXN "), F.col("txn_id"), F.lit(" not found")).alias("detail"),
    )
    return bad.unionByName(lost)


def review_queue(ledger: DataFrame) -> DataFrame:
    """Rows waiting for a decision."""
    return ledger.where(F.col("status") == "QUARANTINED")
