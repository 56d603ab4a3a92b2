import hashlib
import hmac
import math
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywatch.functions import digits, hashing, normal, ratios, risk, timeparts
from tallywatch.functions.model import score_with

NS = 10**9


def one(spark, value, expr, kind="bigint"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("amount, digit", [(0, None), (-5, 5), (1, 1), (9, 9), (2**31, 2), (2**32 + 1, 4), (10**11, 1)])
def test_leading_digit(spark, amount, digit):
    assert one(spark, amount, digits.leading_digit) == digit


@pytest.mark.parametrize("amount", [0, -5, 1, 100, 50000, 900000, 999999, 10000000, 2**32])
def test_benford_deviation(spark, amount):
    got = one(spark, amount, digits.benford_deviation)
    if amount <= 0:
        assert got == 0.5
        return
    table = [0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046]
    d = int(str(amount)[0])
    assert got == pytest.approx(abs(math.log10(1 + 1 / d) - table[d - 1]) / table[d - 1])


@pytest.mark.parametrize("text, digit", [("00a7f", 7), ("abc", None), ("", None), (None, None), ("0900", 9)])
def test_hash_digit(spark, text, digit):
    assert one(spark, text, digits.hash_digit, "string") == digit


def test_calendar_parts(spark):
    rows = {
        "2024-01-05T05:59:59": (5, 4, True, False), "2024-01-05T06:00:00": (6, 4, False, False),
        "2024-01-05T22:59:59": (22, 4, False, False), "2024-01-05T23:00:00": (23, 4, True, False),
        "2024-01-06T00:00:00": (0, 5, True, True), "1969-12-31T23:00:00": (23, 2, True, False),
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string").withColumn(
        "ns", F.unix_micros(F.col("t").cast("timestamp")) * 1000)
    ns = F.col("ns")
    for r in df.select("t", timeparts.hour_of_day(ns), timeparts.weekday(ns), timeparts.is_offhours(ns),
                       timeparts.is_weekend(ns), timeparts.date_bucket(ns).cast("string").alias("d"),
                       timeparts.event_time(ns).cast("string").alias("e")).collect():
        assert tuple(r)[1:5] == rows[r["t"]]
        assert r["d"] == r["t"][:10]
        assert r["e"] == r["t"].replace("T", " ")


def test_hash_and_mac(spark):
    ids = ["ACC-1", "", "ß-2"] * 3
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string")
    rows = df.select("id", hashing.hash_id(F.col("id"), "sha2").alias("a"), hashing.hash_id(F.col("id"), "sha3").alias("b"),
                     hashing.hmac_sha256(b"k" * 100, F.col("id")).alias("m")).collect()
    for r in rows:
        if r["id"] is None:
            assert r["a"] is None and r["b"] is None
            continue
        assert r["a"] == hashlib.sha256(r["id"].encode()).hexdigest()
        assert r["b"] == hashlib.sha3_256(r["id"].encode()).hexdigest()
        assert r["m"] == hmac.new(b"k" * 100, r["id"].encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("name, code", [("RTGS", 0), ("neft", 1), ("FX_CONVERSION", 5), ("other", 0), (None, 0)])
def test_type_codes(spark, name, code):
    assert one(spark, name, risk.txn_type_code, "string") == code


@pytest.mark.parametrize("score, status, severity", [
    (0.4999, "VERIFIED", "LOW"), (0.5, "VERIFIED", "MEDIUM"), (0.75, "QUARANTINED", "HIGH"),
    (0.85, "QUARANTINED", "HIGH"), (0.9, "QUARANTINED", "CRITICAL"), (None, "VERIFIED", "LOW"),
])
def test_bands(spark, score, status, severity):
    assert one(spark, score, risk.status_of, "double") == status
    assert one(spark, score, risk.severity_of, "double") == severity


@pytest.mark.parametrize("score, hops, name, dev, flag", [
    (0.95, 1, "SOME_LIST", 0.0, "SOME_LIST"), (0.95, 0, "SOME_LIST", 0.0, "SOME_LIST"), (0.95, 3, "SOME_LIST", 0.0, "HIGH_ANOMALY_SCORE"),
    (0.85, 1, "SOME_LIST", 0.0, "HIGH_ANOMALY_SCORE"), (0.95, 8, "NONE", 0.0, "HIGH_ANOMALY_SCORE"),
    (0.75, 1, "SOME_LIST", 0.8, "BENFORD_VIOLATION"), (0.75, 1, "SOME_LIST", 0.7, "NONE"),
])
def test_flags(spark, score, hops, name, dev, flag):
    df = spark.createDataFrame([(score, hops, name, dev)], "s double, h int, l string, d double")
    assert df.select(risk.flag_reason(F.col("s"), F.col("h"), F.col("l"), F.col("d")).alias("f")).first()["f"] == flag


def expected_score(amount, velocity, hops, offhours, dev):
    log_amount = math.log1p(amount) if amount > 0 else 0.0
    extreme = min(max(0.0, (log_amount - 20) / 5), 1.0)
    total = (0.25 * dev + 0.30 * max(0.0, 1 - min(hops / 8, 1)) + 0.20 * min(velocity / 100, 1)
             + 0.15 * offhours + 0.10 * extreme)
    return max(0.0, min(1.0, total))


@pytest.mark.parametrize("amount", [0, -5, 500000, 2**32, 10**11])
@pytest.mark.parametrize("velocity, hops, hour", [(1, 8, 12), (29, 1, 3), (57, 2, 23), (58, 3, 6), (150, 4, 22)])
def test_scores(spark, amount, velocity, hops, hour):
    df = spark.createDataFrame([(amount, "RTGS", hour * 3600 * NS, velocity, hops)],
                               "a bigint, t string, ns bigint, v bigint, h int")
    f = risk.feature_struct(*[F.col(c) for c in ("a", "t", "ns", "v", "h")])
    row = df.select(f.alias("f"), risk.behavioral_delta(F.col("ns"), F.col("v")).alias("b")).withColumn(
        "s", risk.rule_score(F.col("f"))).withColumn(
        "l", risk.reconstruction_loss(F.col("s"), F.col("f.benford_deviation"))).first()
    off = 1 if hour < 6 or hour > 22 else 0
    dev = row["f"]["benford_deviation"]
    assert row["s"] == pytest.approx(expected_score(amount, velocity, hops, off, dev))
    assert 0 <= row["s"] <= 1 and 0 <= row["l"] <= 1.1
    assert row["l"] == pytest.approx(row["s"] * (1 - 0.05 * dev))
    assert row["b"]["velocity_1h"] == velocity and row["b"]["is_offhours"] == bool(off)
    assert list(row["f"].asDict()) == risk.FEATURES


def test_score_never_reaches_default_threshold():
    assert expected_score(10**15, 1000, 1, 1, 0.0053) < 0.75


def test_model_hook(spark):
    df = spark.createDataFrame([(100, "RTGS", 0, 1, 8), (200, "NEFT", 0, 2, 8)], "a bigint, t string, ns bigint, v bigint, h int")
    f = df.select("a", risk.feature_struct(*[F.col(c) for c in ("a", "t", "ns", "v", "h")]).alias("f"))

    def load():
        return lambda matrix: matrix[:, 0] - matrix[:, 0].max() - 0.2

    rows = f.select("a", score_with(F.col("f"), load).alias("m"), score_with(F.col("f")).alias("r")).collect()
    assert all(0 <= r["m"] <= 1 for r in rows)
    assert {r["m"] for r in rows} <= {0.7, 1.0}
    assert all(r["r"] < 0.3 for r in rows)


@pytest.mark.parametrize("z", [-6.0, -1.96, -0.5, 0.0, 0.5, 1.0, 1.96, 6.0])
def test_normal_cdf(spark, z):
    assert one(spark, z, normal.normal_cdf, "double") == pytest.approx(statistics.NormalDist().cdf(z), abs=1e-7)


@settings(max_examples=20, deadline=None)
@given(part=st.integers(0, 10**6), extra=st.integers(0, 10**6))
def test_percent_rounds_half_up(spark, part, extra):
    whole = part + extra
    exact = (part * 200 * 100 + whole) // (2 * whole) / 100 if whole else 0.0
    df = spark.createDataFrame([(part, whole)], "p bigint, w bigint")
    assert df.select(ratios.percent(F.col("p"), F.col("w"), 2).alias("x")).first()["x"] == exact


def test_entry_side(spark):
    got = [one(spark, t, risk.entry_side, "string") for t in ("WIRE_TRANSFER", "RTGS", "NEFT")]
    assert got == ["DEBIT", "DEBIT", "CREDIT"]
