import math
import statistics

import pytest
from pyspark.sql import functions as F

from tallywatch.functions.digits import EXPECTED_PCT, leading_digit
from tallywatch.operators import benford, distribution, feeds, rules, throughput
from tallywatch.sources.raw import route, union_topics

NS = 10**9


def amounts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "amount_cents bigint")


def digit():
    return leading_digit(F.col("amount_cents"))


def test_benford_table(spark):
    values = [100, 150, 1, 19, 200, 3, 37, 999, 0, -45]
    rows = benford.benford_table(amounts(spark, *values), digit()).orderBy("digit").collect()
    counts = [4, 1, 2, 1, 0, 0, 0, 0, 1]
    assert [r["n"] for r in rows] == counts and [r["expected_pct"] for r in rows] == EXPECTED_PCT
    observed = [round(c / 9 * 100, 2) for c in counts]
    assert [r["observed_pct"] for r in rows] == observed
    chi = sum((o - e) ** 2 / e for o, e in zip(observed, EXPECTED_PCT))
    assert rows[0]["chi2_statistic"] == pytest.approx(round(chi, 3)) and rows[0]["deviation_flag"] == (chi > 15.5)
    assert rows[0]["chi2_counts"] == pytest.approx(sum((c - 9 * e / 100) ** 2 / (9 * e / 100) for c, e in zip(counts, EXPECTED_PCT)))


def test_benford_empty(spark):
    rows = benford.benford_table(amounts(spark), digit()).collect()
    assert len(rows) == 9
    assert {(r["observed_pct"], r["chi2_statistic"], r["deviation_flag"], r["sample_count"]) for r in rows} == {(0.0, 0.0, False, 0)}


def test_benford_groups(spark):
    df = spark.createDataFrame([("a", 9), ("a", 91), ("b", 1)], "k string, amount_cents bigint")
    rows = benford.benford_table(df, digit(), ["k"]).collect()
    assert len(rows) == 18 and sum(r["n"] for r in rows) == 3
    assert {r["k"]: r["sample_count"] for r in rows} == {"a": 2, "b": 1}


def scores(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "anomaly_score double")


def test_distribution(spark):
    values = [0.1, 0.2, 0.4, 0.9]
    row = distribution.score_stats(scores(spark, None, *values)).first()
    assert row["n"] == 4 and row["mu"] == pytest.approx(0.4) and row["sigma"] == pytest.approx(statistics.stdev(values))
    assert row["peak"] == pytest.approx(1 / (row["sigma"] * math.sqrt(2 * math.pi)))


def test_distribution_edges(spark):
    empty = distribution.score_stats(scores(spark)).first()
    assert (empty["n"], empty["mu"], empty["sigma"], empty["peak"]) == (0, 0.12, 0.08, 0.0)
    assert distribution.score_stats(scores(spark, 0.3)).first()["sigma"] == 0.001
    assert distribution.density_curve(scores(spark)).count() == 0


def test_curve_and_percentiles(spark):
    values = [0.1, 0.2, 0.15, 0.12, 0.94]
    df = scores(spark, *values)
    curve = distribution.density_curve(df).orderBy("i").collect()
    mu, sigma = statistics.mean(values), statistics.stdev(values)
    assert len(curve) == 200 and curve[0]["x"] == 0.0 and curve[-1]["x"] == 1.0
    assert curve[7]["y"] == pytest.approx(statistics.NormalDist(mu, sigma).pdf(curve[7]["x"]))
    top = distribution.outlier_percentiles(df).where("anomaly_score = 0.94").first()
    assert top["percentile"] == pytest.approx(100 * statistics.NormalDist(mu, sigma).cdf(0.94), abs=0.01) and top["percentile"] > 90
    assert distribution.outlier_percentiles(df).select(distribution.percentile_label(F.lit(94.14))).first()[0] == "94.1th"


def test_sizes(spark):
    df = spark.createDataFrame([(s,) for s in (0.25, 0.75, 1.25, 0.0, -1.0, 8.0)], "size_kb double")
    got = {tuple(r) for r in distribution.size_histogram(df).collect()}
    assert got == {(0.0, 1), (1.0, 2), (8.0, 1)}
    row = distribution.size_summary(spark.createDataFrame([(8.0,)] * 20, "size_kb double")).first()
    assert (row["total_records"], row["avg_kb"]) == (20, 8.0)


def at(spark, *seconds):
    return spark.createDataFrame([(int(s * NS),) for s in seconds], "timestamp_ns bigint")


def test_rates(spark):
    df = at(spark, 100, 100.5, 101, 140)
    sliding = {r["window_end_s"]: r["n"] for r in throughput.sliding_rate(df).collect()}
    assert sliding[101] == 2 and sliding[102] == 3 and sliding[130] == 3 and sliding[131] == 1 and 132 not in sliding
    assert sliding[141] == 1 and sliding[170] == 1 and len(sliding) == 61
    history = throughput.rate_history(df, 5, 10).orderBy("bar").collect()
    assert [r["tps"] for r in history] == [0.3, 0.0, 0.0, 0.0, 0.1] and [r["label"] for r in history][0] == "-5s"
    earlier = throughput.rate_history(df, 2, 10, F.lit(10).cast("bigint")).orderBy("bar").collect()
    assert [r["tps"] for r in earlier] == [0.0, 0.3]
    summary = throughput.rate_summary(throughput.rate_history(df, 5, 10)).first()
    assert (summary["peak"], summary["avg"]) == (0.3, 0.1)
    life = throughput.lifetime_rate(df).first()
    assert (life["total"], life["tps"]) == (4, 0.1) and throughput.lifetime_rate(at(spark, 5)).first()["tps"] == 1.0


def test_rates_empty(spark):
    none = at(spark)
    assert [r["tps"] for r in throughput.rate_history(none, 3).collect()] == [0.0] * 3
    assert tuple(throughput.lifetime_rate(none).first()) == (0, 0.0, 0.0)


def records(spark, n):
    return spark.createDataFrame([(f"TXN-{i:012d}", i, (i % 10) / 10 + 0.05) for i in range(n)],
                                 "txn_id string, timestamp_ns bigint, anomaly_score double")


def test_feeds(spark):
    df = records(spark, 40)
    assert [r["timestamp_ns"] for r in feeds.newest(df, 3).collect()] == [39, 38, 37]
    assert [r["timestamp_ns"] for r in feeds.oldest(df, 2).collect()] == [0, 1]
    both = union_topics({"a": df, "b": df.where("timestamp_ns < 5")})
    got = feeds.last_per_topic(both, ["a", "b"], 7).collect()
    assert sorted(r["timestamp_ns"] for r in got if r["topic"] == "a") == list(range(33, 40))
    assert sorted(r["timestamp_ns"] for r in got if r["topic"] == "b") == list(range(5))
    assert {r["rank"]: r["timestamp_ns"] for r in got if r["topic"] == "b"} == {i + 1: 4 - i for i in range(5)}
    assert route(both, ["a", "b"])["b"].count() == 5


def test_alerts(spark):
    df = spark.createDataFrame([
        ("TXN-A001", 0.95, "OFAC_SANCTION_LIST", 1), ("TXN-A002", 0.80, "RBI_FLAG_2024", 2), ("TXN-LONG-ID-0003", 0.80, None, 3),
    ], "txn_id string, anomaly_score double, flag_reason string, timestamp_ns bigint")
    rows = feeds.alert_feed(df).collect()
    assert [r["severity"] for r in rows] == ["CRITICAL", "HIGH", "HIGH"] and rows[1]["timestamp_ns"] == 3
    assert rows[1]["message"] == "HIGH_ANOMALY_SCORE: LONG-ID-0003"
    # the newest are chosen before they are ranked
    assert [r["txn_id"] for r in feeds.alert_feed(df, 1).collect()] == ["TXN-LONG-ID-0003"]
    assert feeds.alert_feed(df.where("false")).count() == 0


TXN = "txn_id string, account_id string, counterparty_id string, amount_cents bigint, currency string, txn_type string, timestamp_ns bigint, metadata map<string,string>"


def txn(i, amount=500, account="A", other="B", kind="NEFT", currency="INR", hour=12, city="Mumbai", **meta):
    return (i, account, other, amount, currency, kind, hour * 3600 * NS, {"city": city, **meta})


def hits(df):
    return sorted(r["txn_id"] for r in df.collect())


def test_rules(spark):
    df = spark.createDataFrame([
        txn("limit", 100_000_000 - 100, kind="RTGS"), txn("at", 100_000_000, kind="RTGS"), txn("gap", 100_000_000 - 101, kind="RTGS"),
        txn("far", city="Cayman Islands", hour=3), txn("home", hour=3), txn("noon", city="Lima"),
        txn("low", 99), txn("high", 20_000_001), txn("odd", kind="BARTER"), txn("coin", currency="XAU"), txn("self", other="A"),
        txn("hint", flag_hint="OFAC_SANCTION_LIST"),
    ], TXN)
    assert hits(rules.structuring(df)) == ["limit"]
    assert hits(rules.unusual_place(df, F.col("metadata")["city"])) == ["far"]
    assert hits(rules.list_hint(df)) == ["hint"]
    assert hits(rules.out_of_range(df)) == ["high", "low"]
    assert {r["txn_id"]: r["reject_reason"] for r in rules.invalid(df).collect()} == {
        "odd": "UNKNOWN_TYPE", "coin": "UNKNOWN_CURRENCY", "self": "SELF_TRANSFER"}
    assert len(hits(rules.velocity_burst(df, 3))) == 10
    counts = {r["rule"]: r["n"] for r in rules.rule_counts(rules.structuring(df), rules.out_of_range(df)).collect()}
    assert counts == {"STRUCTURING": 1, "OUT_OF_RANGE": 2}


def test_digit_excess(spark):
    rows = [txn(f"x{i}", 900_000_000 + i, account="X") for i in range(20)] + [txn(f"y{i}", 100 + i, account="Y") for i in range(20)]
    got = rules.digit_excess(spark.createDataFrame(rows, TXN)).collect()
    assert [(r["account_id"], r["n"], r["hits"]) for r in got] == [("X", 20, 20)]


def test_delay_sketches_keep_their_bound_and_size(spark):
    """Merged over periods, with a hot period, repeated and null delays; the size does not grow with the rows."""
    from tallywatch.operators import throughput as tp
    rows = spark.range(200_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'a1' ELSE concat('a', id % 7) END AS p", "0L AS e", "CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919) % 50021 * (id % 2) END AS i")
    sizes = []
    for most in (2_000, 200_000):
        part = rows.limit(most)
        small = tp.delay_sketches(part, F.col("e"), F.col("i"), F.col("p"))
        whole = tp.with_quantiles(tp.merged_sketches(small, F.lit("all")), p50=0.5, p95=0.95).first()
        delays = sorted(r.i for r in part.where("i IS NOT NULL").collect())
        assert whole.n == len(delays) and whole.max_delay == delays[-1]
        for share, value in ((0.5, whole.p50), (0.95, whole.p95)):
            low, high = (sum(d < value for d in delays) / len(delays), sum(d <= value for d in delays) / len(delays))
            assert low - tp.RANK_ERROR <= share <= high + tp.RANK_ERROR
        sizes.append(max(len(r.sketch) for r in small.collect()))
    assert sizes[1] < 20_000
    none = tp.delay_sketches(rows.where("i IS NULL"), F.col("e"), F.col("i"), F.col("p"))
    assert none.count() == 7 and tp.merged_sketches(none, F.lit("all")).count() == 0
    assert tp.delay_sketches(rows.where("false"), F.col("e"), F.col("i"), F.col("p")).count() == 0
