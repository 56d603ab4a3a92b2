"""Risk features, scores, bands and flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import DEFAULT_THRESHOLD, TXN_TYPES
from .cases import choose
from .digits import benford_deviation
from .timeparts import hour_of_day, is_offhours, is_weekend, weekday

# Names of the watch lists by tier, the gravest first.
LIST_NAMES = {1: "OFAC_SANCTION_LIST", 2: "RBI_FLAG_2024", 3: "FATF_GREY_LIST"}
NO_LIST = "NONE"
#: Hops of a party from which no list is reached: proximity counts nothing from there on.
FAR = 8

# Weights of the rule-based score.
WEIGHTS = {"benford": 0.25, "proximity": 0.30, "velocity": 0.20, "offhours": 0.15, "extreme": 0.10}

# Severity bands and their least score; anything lower is LOW.
SEVERITIES = [("CRITICAL", 0.90), ("HIGH", 0.75), ("MEDIUM", 0.50)]

FEATURES = [
    "log_amount", "hour_of_day", "day_of_week", "txn_type_enc", "benford_deviation",
    "velocity_1h", "graph_hops", "is_offhours", "is_weekend",
]


def log_amount(amount: Column) -> Column:
    return F.when(amount > 0, F.log1p(amount.cast("double"))).otherwise(F.lit(0.0))


def txn_type_code(txn_type: Column) -> Column:
    """Position in the type list; unknown types count as 0."""
    upper = F.upper(txn_type)
    return choose([(upper == name, code) for code, name in enumerate(TXN_TYPES)], F.lit(0))


def feature_struct(amount: Column, txn_type: Column, ns: Column, velocity: Column, hops: Column) -> Column:
    """The nine model inputs, in model order."""
    values = [
        log_amount(amount),
        hour_of_day(ns) / F.lit(23.0),
        weekday(ns) / F.lit(6.0),
        txn_type_code(txn_type) / F.lit(5.0),
        benford_deviation(amount),
        F.least(velocity / F.lit(100.0), F.lit(1.0)),
        F.least(hops / F.lit(8.0), F.lit(1.0)),
        is_offhours(ns).cast("double"),
        is_weekend(ns).cast("double"),
    ]
    return F.struct(*[value.alias(name) for name, value in zip(FEATURES, values)])


def feature_vector(features: Column) -> Column:
    return F.array(*[features[name] for name in FEATURES])


def unit_clamp(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def rule_score(features: Column) -> Column:
    """Weighted rule score in 0..1."""
    extreme = unit_clamp((features["log_amount"] - F.lit(20.0)) / F.lit(5.0))
    return unit_clamp(
        features["benford_deviation"] * WEIGHTS["benford"]
        + F.greatest(F.lit(0.0), F.lit(1.0) - features["graph_hops"]) * WEIGHTS["proximity"]
        + features["velocity_1h"] * WEIGHTS["velocity"]
        + features["is_offhours"] * WEIGHTS["offhours"]
        + extreme * WEIGHTS["extreme"]
    )


def model_score(raw: Column) -> Column:
    """Map an isolation-forest output (negative = anomalous) to 0..1."""
    return unit_clamp(F.lit(0.5) - raw)


def reconstruction_loss(score: Column, deviation: Column) -> Column:
    return score * (F.lit(1.0) - F.lit(0.05) * deviation)


def behavioral_delta(ns: Column, velocity: Column) -> Column:
    return F.struct(
        is_offhours(ns).alias("is_offhours"),
        is_weekend(ns).alias("is_weekend"),
        velocity.alias("velocity_1h"),
    )


def status_of(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """The threshold itself is quarantined, as in routing."""
    return F.when(score >= threshold, F.lit("QUARANTINED")).otherwise(F.lit("VERIFIED"))


def severity_of(score: Column) -> Column:
    return choose([(score >= least, name) for name, least in SEVERITIES], F.lit("LOW"))


def severity_rank(severity: Column) -> Column:
    names = [name for name, _ in SEVERITIES] + ["LOW"]
    return choose([(severity == name, rank) for rank, name in enumerate(names)], F.lit(9))


def flag_reason(
    score: Column,
    hops: Column,
    list_name: Column,
    deviation: Column,
    list_score: float = 0.85,
    list_hops: int = 2,
    high_score: float = 0.75,
    benford_limit: float = 0.7,
) -> Column:
    return (
        F.when((score > list_score) & (hops <= list_hops) & (list_name != NO_LIST), list_name)
        .when(score > high_score, F.lit("HIGH_ANOMALY_SCORE"))
        .when(deviation > benford_limit, F.lit("BENFORD_VIOLATION"))
        .otherwise(F.lit(NO_LIST))
    )


def entry_side(txn_type: Column) -> Column:
    """High-value types are shown as debits, all others as credits."""
    high = txn_type.contains("WIRE") | txn_type.contains("RTGS")
    return F.when(high, F.lit("DEBIT")).otherwise(F.lit("CREDIT"))
