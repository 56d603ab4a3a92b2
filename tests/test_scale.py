"""Plans that must hold on large and skewed data."""

import contextlib
import re

from pyspark.sql import functions as F

from tallywatch.operators.commit import commit_table
from tallywatch.operators.feeds import last_per_topic, newest
from tallywatch.operators.graph import _bucketed_by_target, _hubs, _incoming, _met, _spread
from tallywatch.operators.rules import unusual_place
from tallywatch.operators.verify import lookup, verify_claims
from tallywatch.operators.velocity import velocity
from tallywatch.session import work_dir
from tallywatch.sources.ledger import append_ledger, latest_by, page_after, read_ledger

KEY = b"scale"


@contextlib.contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


SMALL_SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20000",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20000",
}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def txns(spark, n=60_000):
    """A third of all rows carry one id."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string")))
    return spark.range(0, n, 1, 8).select(
        hot.alias("txn_id"), F.col("id").alias("amount_cents"), F.lit("A").alias("account_id"), F.lit("NEFT").alias("txn_type"),
        (F.col("id") * 1_000_000).alias("timestamp_ns"), F.lit(0.1).alias("anomaly_score"))


def test_hot_id_in_claims_is_split(spark):
    ledger = latest_by(commit_table(txns(spark), KEY), ["txn_id"], ["timestamp_ns"])
    with settings(spark, **SMALL_SKEW):
        out = verify_claims(txns(spark), ledger, KEY).select("txn_id", "outcome")
        assert "skew=true" in executed(out)
        counts = {r["outcome"]: r["n"] for r in out.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    # only the last of the repeated id's amounts is held
    assert counts == {"VERIFIED": 40_001, "FAILED": 19_999}


def test_hot_id_in_lookup_is_split(spark):
    ledger = latest_by(commit_table(txns(spark), KEY), ["txn_id"], ["timestamp_ns"])
    with settings(spark, **SMALL_SKEW):
        out = lookup(txns(spark).select("txn_id", F.sha2(F.col("amount_cents").cast("string"), 256).alias("pad")), ledger)
        assert "skew=true" in executed(out.select("txn_id", "pad", "found", "binding_hash"))
        assert out.count() == 60_000


def test_hot_place_is_split(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("txn_id"), F.lit(3 * 3600 * 10**9).alias("timestamp_ns"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("A"), F.col("id").cast("string"))).alias("account_id"))
    with settings(spark, **SMALL_SKEW):
        out = unusual_place(rows, F.lit("night club"))
        assert "skew=true" in executed(out)
        assert out.count() == 40_000


def test_copies_collapse_before_the_shuffle(spark):
    plan = planned(latest_by(txns(spark), ["txn_id"], ["timestamp_ns"]))
    assert re.search(r"Aggregate.*max_by.*Exchange.*partial_max_by", plan, re.S)


def test_velocity_shuffles_instants_not_rows(spark):
    plan = planned(velocity(txns(spark).select("txn_id", "account_id", "timestamp_ns")))
    assert "partial_count" in plan
    # the widest window is split by account and slot, never by account alone
    for spec in re.findall(r"Exchange hashpartitioning\(account_id#\d+,? ?([^)]*?), 8\)", plan):
        assert spec.startswith(("timestamp_ns", "_slot", "block"))


def test_velocity_join_splits_a_hot_instant(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("A"), F.col("id").cast("string"))).alias("account_id"),
        F.lit(5).cast("bigint").alias("timestamp_ns"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    with settings(spark, **SMALL_SKEW):
        out = velocity(rows)
        assert "skew=true" in executed(out)
        assert out.where("account_id = 'HOT'").select("velocity").distinct().collect()[0][0] == 30_000


def test_ranks_are_limited_before_the_shuffle(spark):
    df = txns(spark).withColumn("topic", F.lit("a"))
    assert planned(last_per_topic(df, ["a", "b"], 500)).count("TakeOrderedAndProject") >= 1
    assert "TakeOrderedAndProject" in planned(newest(df, 50))


def test_edges_are_not_shuffled_again(spark):
    edges = spark.range(1000).select(F.col("id").cast("string").alias("src"), (F.col("id") % 7).cast("string").alias("dst"))
    hubs = _hubs(edges, 100).checkpoint()
    assert {r["parts"] for r in hubs.collect()} == {2}
    spread = _spread(spark.createDataFrame([("3",)], "node string"), hubs).checkpoint()
    assert spread.count() == 2
    name = "edges_planned"
    incoming = _bucketed_by_target(edges, hubs, name)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = planned(incoming.join(spread, ["dst", "part"]))
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {name}")


def test_edges_are_not_sorted_for_a_hop(spark):
    """Edges lie in columnar files and stream past the frontier."""
    edges = spark.range(1000).select(F.col("id").cast("string").alias("src"), (F.col("id") % 7).cast("string").alias("dst"))
    listed = spark.createDataFrame([("3", "x")], "node string, tag string").checkpoint()
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), _incoming(edges, 100) as (incoming, hubs):
        for more in ([], ["tag"]):
            met = _met(incoming, listed, hubs, *more).select("src", *more)
            plan = planned(met)
            edges_side = plan[plan.index("ShuffledHashJoin"):]
            assert "Bucketed: true" in plan and "Sort" not in edges_side[: edges_side.index("FileScan")]
            assert met.count() == 143


def test_stored_ledger_is_read_in_part(spark):
    """Two columns for a verification, and a filter on the day that passes the last write per id."""
    path = work_dir(spark, "stored")
    append_ledger(commit_table(txns(spark), KEY), path, 0)
    claims = txns(spark).select("txn_id", "amount_cents")
    plan = planned(verify_claims(claims, read_ledger(spark, path, columns=["txn_id", "binding_hash"]), KEY))
    assert "commitment_b64" not in plan and "anomaly_score" not in plan
    page = page_after(read_ledger(spark, path, columns=["txn_id", "timestamp_ns", "binding_hash", "date_bucket"]), (10**18, ""), 5)
    assert re.search(r"PartitionFilters: \[[^\]]*date_bucket", planned(page))


def test_page_prunes_days_and_pushes_its_filter(spark):
    path = work_dir(spark, "paged")
    append_ledger(commit_table(txns(spark).withColumn("timestamp_ns", F.col("amount_cents") * 10**11), KEY), path)
    cursor = (10**11 * 30_000, "")
    page = page_after(spark.read.parquet(path), cursor, 5)
    plan = planned(page)
    assert re.search(r"PartitionFilters: \[[^\]]*date_bucket", plan) and "GreaterThanOrEqual(timestamp_ns" in plan
    assert [r["timestamp_ns"] for r in page.collect()] == [10**11 * (30_000 + i) for i in range(5)]


def test_envelope_checks_compute_each_mac_once(spark):
    from tallywatch.plans import fixtures as fx
    from tallywatch.operators.envelope import check_counts, check_envelopes
    checked = check_envelopes(fx.envelopes(spark, "/root/testdata/sf0.001"))
    for frame in (checked.select("checks"), check_counts(checked), checked.select("overall")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("sha2(") <= 6


def test_a_few_ids_do_not_shuffle_the_ledger(spark, tmp_path):
    from tallywatch.operators.verify import lookup
    path = str(tmp_path / "ledger")
    spark.range(20000).selectExpr("concat('T', id) AS txn_id", "repeat(md5(cast(id AS string)), 40) AS binding_hash").write.parquet(path)
    ids = spark.createDataFrame([("T5",), ("T17",), ("T99999",), ("T5",)], "txn_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        found = lookup(ids, spark.read.parquet(path))
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.txn_id, r.found) for r in rows) == [("T17", True), ("T5", True), ("T5", True), ("T99999", False)]
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_a_token_of_every_row_is_collapsed_before_the_shuffle(spark):
    """Search for leaked ids: one aggregate over the value, no join that one value could crowd into a task."""
    from tallywatch.operators.privacy import leaked_ids
    raw = spark.range(2000).select(F.concat(F.lit("ACC-"), F.col("id")).alias("account_id"), F.lit("ACC-7").alias("counterparty_id"))
    export = raw.select(F.lit("ok").alias("memo"), F.when(F.col("account_id") == "ACC-3", F.lit("to ACC-7 of ACC-7")).alias("note"))
    found = leaked_ids(export, raw)
    plan = planned(found)
    assert "Join" not in plan and re.search(r"Exchange hashpartitioning\(value.*partial_", plan, re.S)
    assert [tuple(r) for r in found.collect()] == [("note", "ACC-7", 2)]


def test_resolved_ledger_carries_no_column_twice(spark):
    from tallywatch.plans.ingest import ledger_round_trip
    plan = ledger_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "commitment_b64" not in plan and "account_hash" not in plan
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, None), ("b", None, None)], "k string, seq int, v string")
    assert {tuple(r) for r in latest_by(df, ["k"], ["seq", "v"]).collect()} == {("a", 3, "y"), ("b", None, None)}
    assert "max_by" not in planned(latest_by(df, ["k"], ["seq", "v"]))
    assert {tuple(r) for r in latest_by(df.select("k"), ["k"], ["k"]).collect()} == {("a",), ("b",)}


def test_large_deliveries_have_several_files(spark, monkeypatch):
    """A file is one task of a batch: half a million rows of a delivery are not left to one."""
    from tallywatch.plans import streams
    folders = []
    monkeypatch.setattr(streams, "work_dir", lambda spark, name: folders.append(work_dir(spark, name)) or folders[-1])
    streams.deliver(spark.range(1000), "wide", [F.lit(True)], 2_000_000)
    assert len(spark.read.parquet(folders[0]).inputFiles()) == 5
