"""Risk features and scores for whole transaction tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import risk
from ..functions.joins import spread_join
from ..functions.model import score_with
from .proximity import with_proximity
from .velocity import velocity


def with_features(hashed: DataFrame, near: DataFrame, window_s: int = 3600, of: DataFrame | None = None) -> DataFrame:
    """Add ``velocity``, ``hops``, ``list_name``, ``nearer`` and the ``features`` struct to pseudonymised rows.

    ``near`` holds the nearest watch list of each account hash, see :func:`graph.nearest_lists`.
    With ``of``, some of the rows, only these are given; velocity counts all. The velocity goes by the
    account id where it is still there, which is far shorter than its hash.
    """
    key = "account_id" if "account_id" in hashed.columns else "account_hash"
    counted = with_proximity(velocity(hashed, key=key, window_s=window_s, of=of), near, paths=False)
    return counted.withColumn("features", risk.feature_struct(
        F.col("amount_cents"), F.col("txn_type"), F.col("timestamp_ns"), F.col("velocity"), F.col("hops")
    ))


def with_score(featured: DataFrame, load_model: Callable | None = None, threshold: float = 0.75) -> DataFrame:
    """Add score, reconstruction loss, flag, behavioural delta and status."""
    scored = featured.withColumn("score", score_with(F.col("features"), load_model))
    deviation = F.col("features.benford_deviation")
    return scored.withColumns({
        "reconstruction_loss": risk.reconstruction_loss(F.col("score"), deviation),
        "flag_reason": risk.flag_reason(F.col("score"), F.col("hops"), F.col("list_name"), deviation),
        "behavioral_delta": risk.behavioral_delta(F.col("timestamp_ns"), F.col("velocity")),
        "status": risk.status_of(F.col("score"), threshold),
    })


def anomaly_detail(ledger: DataFrame, scored: DataFrame) -> DataFrame:
    """Ledger records, one per id, with the score computed where the amounts are known.

    ``nearer`` names the party nearer to a list; :func:`proximity.with_paths` adds the transfers.
    """
    extra = scored.select(
        "txn_id", "counterparty_hash", "score", "reconstruction_loss", "hops", "list_name", "nearer", "flag_reason",
        "features", "behavioral_delta",
    )
    return spread_join(ledger, extra, ["txn_id"], "inner")
