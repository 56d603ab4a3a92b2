"""Feature, score, proximity and rule queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import risk as rk
from ..functions.digits import benford_deviation
from ..functions.timeparts import hour_of_day, is_offhours, is_weekend, weekday
from ..operators import rules
from ..operators.graph import hops_to_blacklist, transfer_edges
from ..operators.proximity import proximity_edges, with_proximity
from ..operators.scoring import anomaly_detail, with_features, with_score
from ..operators.velocity import velocity
from . import fixtures as fx
from .registry import query
from .sqltext import HOUR, OFFHOURS, STATUS, WEEKDAY, WEEKEND, benford_gap, digit_of, views

SCORE_THRESHOLD = 0.32


def featured(spark, sf, near=None):
    return with_features(fx.hashed_txns(spark, sf), fx.nearest(spark, sf) if near is None else near)


def scored(spark, sf, near=None):
    return with_score(featured(spark, sf, near), threshold=SCORE_THRESHOLD)


@query(f"""{views('scored')} SELECT txn_type, status, count(*) AS n, round(avg(score), 6) AS avg_score,
    round(max(score), 6) AS max_score, max(velocity) AS max_velocity FROM scored GROUP BY ALL""")
def risk_overview(spark, sf):
    """Scored transactions by type and status: the flagship."""
    return scored(spark, sf).groupBy("txn_type", "status").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.max("score"), 6).alias("max_score"), F.max("velocity").alias("max_velocity"),
    )


@query(f"{views('counted')} SELECT txn_id, account_id, velocity FROM counted")
def account_velocity(spark, sf):
    """Transactions of the account in the last hour."""
    return velocity(fx.raw_txns(spark, sf)).select("txn_id", "account_id", "velocity")


@query(f"""{views('raw')} SELECT txn_id, count(*) OVER (PARTITION BY txn_type ORDER BY timestamp_ns
    RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW) AS velocity FROM raw""")
def type_velocity_day(spark, sf):
    """Transactions of the same type in the last day: few, very large groups."""
    return velocity(fx.raw_txns(spark, sf), key="txn_type", window_s=86400, slot_s=60).select("txn_id", "velocity")


@query(f"""{views('raw')} SELECT txn_id, {STATUS} AS status,
    CASE WHEN anomaly_score >= 0.9 THEN 'CRITICAL' WHEN anomaly_score >= 0.75 THEN 'HIGH'
         WHEN anomaly_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CASE WHEN txn_type LIKE '%WIRE%' OR txn_type LIKE '%RTGS%' THEN 'DEBIT' ELSE 'CREDIT' END AS side FROM raw""")
def status_and_severity(spark, sf):
    """Status, severity band and entry side per transaction."""
    score = F.col("anomaly_score")
    return fx.raw_txns(spark, sf).select(
        "txn_id", rk.status_of(score).alias("status"), rk.severity_of(score).alias("severity"),
        rk.entry_side(F.col("txn_type")).alias("side"),
    )


def placed(spark, sf):
    return with_proximity(fx.hashed_txns(spark, sf), fx.nearest(spark, sf), paths=False)


@query(f"""{views('near')} SELECT txn_id, CASE WHEN anomaly_score > 0.85 AND hops <= 2 THEN list_name
    WHEN anomaly_score > 0.75 THEN 'HIGH_ANOMALY_SCORE' ELSE 'NONE' END AS flag_reason FROM near""")
def flag_reasons(spark, sf):
    """Flags from the received score and the watch-list distance."""
    flag = rk.flag_reason(F.col("anomaly_score"), F.col("hops"), F.col("list_name"), benford_deviation(F.col("amount_cents")))
    return placed(spark, sf).select("txn_id", flag.alias("flag_reason"))


@query(f"{views('near')} SELECT txn_id, hops, list_name FROM near")
def watch_list_lookup(spark, sf):
    """Transfers to the nearest watch list from either party."""
    return placed(spark, sf).select("txn_id", "hops", "list_name")


@query(f"""{views('nearest')} SELECT node, hops, tier, list_name FROM nearest""")
def nearest_watch_list(spark, sf):
    """Nearest watch list of every account."""
    return fx.nearest(spark, sf).drop("path")


@query(f"{views('raw')} SELECT txn_id, round({benford_gap('amount_cents')}, 9) AS deviation FROM raw")
def benford_deviations(spark, sf):
    return fx.raw_txns(spark, sf).select("txn_id", F.round(benford_deviation(F.col("amount_cents")), 9).alias("deviation"))


@query(f"""{views('raw')} SELECT txn_id, CAST({HOUR} AS INTEGER) AS hour, CAST({WEEKDAY} AS INTEGER) AS weekday, {OFFHOURS} AS offhours,
    {WEEKEND} AS weekend FROM raw""")
def calendar_features(spark, sf):
    ns = F.col("timestamp_ns")
    return fx.raw_txns(spark, sf).select(
        "txn_id", hour_of_day(ns).alias("hour"), weekday(ns).alias("weekday"), is_offhours(ns).alias("offhours"),
        is_weekend(ns).alias("weekend"),
    )


@query(f"""{views('features')} SELECT txn_id, {', '.join(f'round({name}, 9) AS {name}' for name in rk.FEATURES)}
    FROM features""")
def feature_vectors(spark, sf):
    """The nine model inputs."""
    return featured(spark, sf).select(
        "txn_id", *[F.round(F.col(f"features.{name}"), 9).alias(name) for name in rk.FEATURES]
    )


@query(f"""{views('scored')} SELECT txn_id, round(score, 9) AS score, round(reconstruction_loss, 9) AS loss, hops,
    flag_reason, status, {OFFHOURS} AS offhours, {WEEKEND} AS weekend, velocity FROM scored""")
def rule_scores(spark, sf):
    """Score, loss, flag, status and behavioural delta per transaction."""
    return scored(spark, sf).select(
        "txn_id", F.round("score", 9).alias("score"), F.round("reconstruction_loss", 9).alias("loss"), "hops",
        "flag_reason", "status", F.col("behavioral_delta.is_offhours").alias("offhours"),
        F.col("behavioral_delta.is_weekend").alias("weekend"), F.col("behavioral_delta.velocity_1h").alias("velocity"),
    )


MODEL_WEIGHTS = [0.01, -0.2, 0.05, 0.1, -0.5, -0.7, 0.3, -0.1, 0.02]


def demo_model():
    """Stands in for a trained model: loaded once per task."""
    weights = np.array(MODEL_WEIGHTS)
    return lambda matrix: matrix @ weights


@query(f"""{views('features')} SELECT txn_id, round(greatest(0.0, least(1.0, 0.5 - (
    {' + '.join(f'({w}) * {name}' for w, name in zip(MODEL_WEIGHTS, rk.FEATURES))}))), 6) AS score FROM features""")
def model_scores(spark, sf):
    """An external model over the feature vector."""
    return with_score(featured(spark, sf), demo_model).select("txn_id", F.round("score", 6).alias("score"))


@query(f"""{views('scored')} SELECT txn_id, CAST(w.seq - 1 AS INTEGER) AS seq, b.stop AS src, w.stop AS dst,
    CASE WHEN w.seq = hops THEN CAST(hops AS VARCHAR) || CASE WHEN hops > 1 THEN ' HOPS' ELSE ' HOP' END ELSE 'TRANSFERS_TO' END AS label,
    CASE WHEN w.seq = hops THEN list_name ELSE w.stop END AS dst_label
    FROM scored s JOIN way w ON w.node = s.party JOIN way b ON b.node = w.node AND b.seq = w.seq - 1""")
def proximity_paths(spark, sf):
    """Transfers from each transaction's nearer party to the watch list."""
    near = fx.nearest(spark, sf)
    return proximity_edges(scored(spark, sf, near), near)


@query(f"""{views('scored', 'ledger')} SELECT l.txn_id, l.binding_hash, l.status, round(s.score, 9) AS score, s.hops,
    s.list_name, s.flag_reason, s.counterparty_hash, round(s.log_amount, 9) AS log_amount
    FROM ledger l JOIN scored s USING (txn_id) WHERE l.status = 'QUARANTINED'""")
def anomaly_details(spark, sf):
    """Quarantined ledger records with their score."""
    held = fx.ledger(spark, sf).where(F.col("status") == "QUARANTINED")
    hashed, near = fx.hashed_txns(spark, sf), fx.nearest(spark, sf)
    # only what is held is joined and scored; velocity counts all rows
    of = hashed.join(held.select("txn_id"), "txn_id", "left_semi")
    scores = with_score(with_features(hashed, near, of=of), threshold=SCORE_THRESHOLD)
    return anomaly_detail(held, scores).select(
        "txn_id", "binding_hash", "status", F.round("score", 9).alias("score"), "hops", "list_name", "flag_reason",
        "counterparty_hash", F.round("features.log_amount", 9).alias("log_amount"),
    )


@query(f"""{views('hashed', 'lists')},
    edges AS (SELECT DISTINCT account_id AS src, counterparty_id AS dst FROM raw WHERE account_id <> counterparty_id),
    walk(node, hops) AS (SELECT account_id, 0 FROM lists UNION
                         SELECT e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.hops < 5)
    SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def blacklist_hops(spark, sf):
    """Transfers from each account to a listed one, up to five."""
    return hops_to_blacklist(transfer_edges(fx.hashed_txns(spark, sf)), fx.watch_lists(spark, sf))


@query("""WITH RECURSIVE pairs AS (SELECT DISTINCT 'C' || CAST(o_custkey AS VARCHAR) AS c, 'S' || CAST(l_suppkey AS VARCHAR) AS s
                         FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    edges AS (SELECT c AS src, s AS dst FROM pairs UNION SELECT s, c FROM pairs),
    walk(node, hops) AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR), 0 FROM supplier WHERE s_acctbal < 0 UNION
                         SELECT e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.hops < 5)
    SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def overdrawn_supplier_hops(spark, sf):
    """Trade links from customers and suppliers to an overdrawn supplier."""
    orders, lines = fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem")
    deals = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("counterparty_id"),
    )
    listed = fx.table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node")
    )
    return hops_to_blacklist(transfer_edges(deals, both_ways=True), listed)


LIMITS, GAP = [10_000_000, 20_000_000, 40_000_000], 100_000
_STRUCTURING = " OR ".join(f"amount_cents >= {limit - GAP} AND amount_cents < {limit}" for limit in LIMITS)


@query(f"{views('order_txns')} SELECT txn_id, 'STRUCTURING' AS rule FROM order_txns WHERE {_STRUCTURING}")
def structuring(spark, sf):
    return rules.structuring(fx.order_txns(spark, sf), LIMITS, GAP)


_PLACE = f"""SELECT txn_id, 'UNUSUAL_PLACE' AS rule FROM raw r WHERE {OFFHOURS}
    AND (SELECT count(*) FROM raw q WHERE q.account_id = r.account_id AND q.k = r.k) < 2"""


@query(f"{views('raw')} {_PLACE}")
def unusual_place(spark, sf):
    """Off-hours rows at a place the account has not used before; the k attribute is the place."""
    return rules.unusual_place(fx.raw_txns(spark, sf), F.col("metadata")["k"])


@query(f"{views('counted')} SELECT txn_id, 'VELOCITY_BURST' AS rule FROM counted WHERE velocity >= 2")
def velocity_burst(spark, sf):
    return rules.velocity_burst(fx.raw_txns(spark, sf), 2)


@query(f"{views('raw')} SELECT txn_id, 'LIST_HINT' AS rule FROM raw WHERE k = 42")
def list_hint(spark, sf):
    raw = fx.raw_txns(spark, sf)
    hint = F.create_map(F.lit("flag_hint"), F.lit("OFAC_SANCTION_LIST"))
    hinted = raw.withColumn("metadata", F.when(F.col("k") == 42, F.map_concat("metadata", hint)).otherwise(F.col("metadata")))
    return rules.list_hint(hinted)


@query(f"""{views('raw')} SELECT account_id, n, hits, round(hits / n, 9) AS share FROM (
    SELECT account_id, count({digit_of('amount_cents')}) AS n, count(*) FILTER ({digit_of('amount_cents')} = 9) AS hits
    FROM raw GROUP BY account_id) WHERE n >= 20 AND hits / n > 0.046""")
def digit_excess(spark, sf):
    """Accounts with more leading nines than the law expects."""
    hits = rules.digit_excess(fx.raw_txns(spark, sf), share=rules.EXPECTED_NINES)
    return hits.withColumn("share", F.round("share", 9))


_RANGES = " OR ".join(
    f"(txn_type = '{name}' AND amount_cents NOT BETWEEN {low} AND {high})" for name, (low, high) in rules.AMOUNT_RANGES.items()
)


@query(f"{views('order_txns')} SELECT txn_id, 'OUT_OF_RANGE' AS rule FROM order_txns WHERE {_RANGES}")
def out_of_range(spark, sf):
    return rules.out_of_range(fx.order_txns(spark, sf))


@query("""SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS txn_id, 'INVALID' AS rule,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN_TYPE' WHEN o_orderstatus = 'P' THEN 'UNKNOWN_CURRENCY'
         ELSE 'SELF_TRANSFER' END AS reject_reason
    FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'P' OR o_totalprice > 400000""")
def invalid_rows(spark, sf):
    """Unknown type, unknown currency, transfer to oneself."""
    rows = fx.order_txns(spark, sf)
    return rules.invalid(rows.withColumns({
        "txn_type": F.when(F.col("txn_type") == "INTERNAL_TRANSFER", F.lit("BARTER")).otherwise(F.col("txn_type")),
        "currency": F.when(F.col("o_orderstatus") == "P", F.lit("XAU")).otherwise(F.col("currency")),
        "counterparty_id": F.when(F.col("amount_cents") > 40_000_000, F.col("account_id")).otherwise(F.col("counterparty_id")),
    }))


@query(f"""{views('order_txns', 'counted')}
    SELECT 'STRUCTURING' AS rule, count(*) AS n FROM order_txns WHERE {_STRUCTURING}
    UNION ALL SELECT 'OUT_OF_RANGE', count(*) FROM order_txns WHERE {_RANGES}
    UNION ALL SELECT 'VELOCITY_BURST', count(*) FROM counted WHERE velocity >= 2""")
def rule_hit_counts(spark, sf):
    """Hits per rule over orders and events."""
    return rules.rule_counts(structuring(spark, sf), out_of_range(spark, sf), velocity_burst(spark, sf))
