import json

import pytest
from pyspark.sql import Observation, functions as F

from tallywatch.operators.privacy import (
    forbidden_columns, leaked_amounts, leaked_ids, pseudonymise, redact, sign, split_pii, split_signed,
)
from tallywatch.operators.status import observe_ingest
from tallywatch.schemas import EXPORT_COLS, FORBIDDEN_COLS
from tallywatch.sources import ledger as store
from tallywatch.sources.raw import normalise_lenient, normalise_strict, parse_raw, split_rejects


def feed(spark, *values):
    texts = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def lenient(spark, *values):
    return normalise_lenient(parse_raw(feed(spark, *values)), F.lit(77).cast("bigint")).collect()


@pytest.mark.parametrize("record, expected", [
    ({"txn_id": "A", "amount_cents": 12}, {"txn_id": "A", "amount_cents": 12, "account_id": "unknown", "txn_type": "UNKNOWN",
                                           "anomaly_score": 0.0, "timestamp_ns": 77, "currency": "INR"}),
    ({"transaction_id": "B", "amount": 19.99, "type": "NEFT"}, {"txn_id": "B", "amount_cents": 1999, "txn_type": "NEFT"}),
    ({"txn_id": "", "transaction_id": "C"}, {"txn_id": "C", "amount_cents": 0}),
    ({"txn_id": "D", "amount_cents": 12.9, "amount": 5}, {"amount_cents": 12}),
    ({"txn_id": "E", "amount_cents": "7", "anomaly_score": "0.5"}, {"amount_cents": 7, "anomaly_score": 0.5}),
    ({"txn_id": "F", "amount_cents": 100000000000, "timestamp_ns": 1704067200000000001},
     {"amount_cents": 10**11, "timestamp_ns": 1704067200000000001}),
    ({"txn_id": "G", "amount_cents": -5, "metadata": {"city": "Delhi", "hour": 3}}, {"amount_cents": -5}),
])
def test_lenient(spark, record, expected):
    row = lenient(spark, record)[0].asDict()
    assert row["reject_reason"] is None
    assert {k: row[k] for k in expected} == expected
    if "metadata" in record:
        assert row["metadata"] == {"city": "Delhi", "hour": "3"}


def test_records_without_id_keep_apart(spark):
    """Each text has an id of its own, the same when it is replayed, also where the fields only look alike."""
    texts = [{"account_id": "A"}, {"counterparty_id": "A"}, {"amount": 1}, {"amount": 2}, {"txn_id": ""}]
    for normalise in (normalise_lenient, normalise_strict):
        ids = [r["txn_id"] for r in normalise(parse_raw(feed(spark, *texts, *texts))).collect()]
        assert len(set(ids)) == len(texts) and ids[:5] == ids[5:] and all(len(i) == 64 for i in ids)


@pytest.mark.parametrize("value, reason", [
    ("not json", "MALFORMED_JSON"), ("", "MALFORMED_JSON"), (None, "MALFORMED_JSON"), ("123", "MALFORMED_JSON"),
    ("[1,2]", "MALFORMED_JSON"), ('{"txn_id": "A"', "MALFORMED_JSON"),
    ({"txn_id": "A", "amount_cents": "ten"}, "BAD_AMOUNT"), ({"txn_id": "A", "amount_cents": 10**30}, "BAD_AMOUNT"),
    ({"txn_id": "A", "amount": "x"}, "BAD_AMOUNT"), ({"txn_id": "A", "anomaly_score": "high"}, "BAD_SCORE"),
    ({"txn_id": "A", "timestamp_ns": "today"}, "BAD_TIMESTAMP"),
])
def test_rejects(spark, value, reason):
    good, bad = split_rejects(normalise_lenient(parse_raw(feed(spark, value))))
    assert good.count() == 0
    rows = bad.collect()
    assert [r["reject_reason"] for r in rows] == [reason]
    assert rows[0]["raw_value"] == (value if value is None or isinstance(value, str) else json.dumps(value))


def test_strict_defaults_and_stable_ids(spark):
    df = feed(spark, {"account_id": "A", "amount_cents": 5}, {"account_id": "B"}, {"txn_id": "X", "transaction_id": "Y"})
    first, second = (normalise_strict(parse_raw(df)).orderBy("account_id").collect() for _ in range(2))
    assert [r["txn_id"] for r in first] == [r["txn_id"] for r in second]
    assert len({r["txn_id"] for r in first}) == 3 and first[0]["txn_id"] == "X"
    b = first[2]
    assert (b["amount_cents"], b["currency"], b["txn_type"], b["metadata"], b["counterparty_id"]) == (0, "INR", "RTGS", {}, "")
    assert b["timestamp_ns"] > 1_600_000_000 * 10**9


def test_parse_reads_each_text_once(spark):
    good, _ = split_rejects(normalise_lenient(parse_raw(feed(spark, {"txn_id": "A"}).repartition(1))))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_observed_counters(spark):
    seen = Observation("ingest")
    rows = normalise_lenient(parse_raw(feed(spark, {"txn_id": "A"}, {"txn_id": "B", "amount": "x"}, "junk")))
    assert observe_ingest(rows, seen).count() == 3
    assert seen.get == {"processed": 1, "errors": 2, "signature_failures": 0}


def raw(spark):
    return spark.createDataFrame(
        [("T1", "ACC-1", "ACC-2", 500000), ("T2", "ACC-2", "ACC-3", 750000)],
        "txn_id string, account_id string, counterparty_id string, amount_cents bigint")


def test_pseudonyms_and_redaction(spark):
    hashed = pseudonymise(raw(spark), "sha3")
    row = hashed.first()
    assert len(row["account_hash"]) == 64 and row["account_hash"] != row["account_id"]
    assert not set(redact(hashed).columns) & set(FORBIDDEN_COLS)


def test_leaks(spark):
    base = pseudonymise(raw(spark))
    clean = base.select("txn_id", "account_hash")
    assert forbidden_columns(clean) == [] and forbidden_columns(base) == ["account_id", "amount_cents", "counterparty_id"]
    assert leaked_ids(clean, raw(spark)).count() == 0 and leaked_amounts(clean, raw(spark)).count() == 0
    dirty = base.select("txn_id", F.col("counterparty_id").alias("memo"), F.col("amount_cents").alias("ref"))
    assert {(r["column"], r["value"], r["n"]) for r in leaked_ids(dirty, raw(spark)).collect()} == {
        ("memo", "ACC-2", 1), ("memo", "ACC-3", 1)}
    assert {tuple(r) for r in leaked_amounts(dirty, raw(spark)).collect()} == {("T1", "ref"), ("T2", "ref")}
    # inside a text and a nested value; an id that only begins alike is no hit
    hidden = base.select(
        "txn_id", F.concat(F.lit("from "), F.col("account_id"), F.lit(", "), F.col("amount_cents").cast("string"), F.lit("!")).alias("memo"),
        F.struct(F.array(F.col("counterparty_id"), F.concat("counterparty_id", F.lit("9")))).alias("deep"),
    )
    found = {(r["column"], r["value"]) for r in leaked_ids(hidden, raw(spark)).collect()}
    assert {("deep", "ACC-2"), ("deep", "ACC-3")} <= found and all(not v.endswith("9") for _, v in found)
    assert {c for c, _ in found} == {"memo", "deep"}
    assert {tuple(r) for r in leaked_amounts(hidden, raw(spark)).collect()} == {("T1", "memo"), ("T2", "memo")}
    # another row's amount is no leak
    swapped = spark.createDataFrame([("T1", "750000")], "txn_id string, memo string")
    assert leaked_amounts(swapped, raw(spark)).count() == 0


def test_pii_split(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), ("c", 4)], "txn_id string, pii_bytes int")
    clean, dirty = split_pii(df)
    assert [r[0] for r in clean.collect()] == ["a", "b"] and [r[0] for r in dirty.collect()] == ["c"]


def test_signatures(spark):
    df = spark.createDataFrame([("T1", "a" * 64)], "txn_id string, binding_hash string")
    signed = sign(df, b"key-1")
    assert split_signed(signed, b"key-1")[0].count() == 1
    assert split_signed(signed, b"key-2")[1].count() == 1
    assert split_signed(signed.withColumn("binding_hash", F.lit("c" * 64)), b"key-1")[1].count() == 1
    assert split_signed(signed.withColumn("txn_id", F.lit("T-FAKE")), b"key-1")[1].count() == 1
    assert split_signed(signed.withColumn("signature", F.lit(None).cast("string")), b"key-1")[1].count() == 1


def rows_at(spark, *pairs):
    return spark.createDataFrame(list(pairs), "timestamp_ns bigint, txn_id string")


def test_paging_keeps_ties_and_crosses_midnight(spark):
    day = 86400 * 10**9
    rows = rows_at(spark, *[(5, f"t{i:02d}") for i in range(7)], (day - 1, "u"), (day, "v"), (day + 1, "w"))
    from tallywatch.functions.timeparts import date_bucket
    dated = rows.withColumn("date_bucket", date_bucket(F.col("timestamp_ns")))
    cursor, seen = (0, ""), []
    for _ in range(10):
        page = store.page_after(dated, cursor, 3)
        seen += [r["txn_id"] for r in page.collect()]
        moved = store.next_cursor(page, cursor)
        if moved == cursor:
            break
        cursor = moved
    assert seen == [f"t{i:02d}" for i in range(7)] + ["u", "v", "w"]
    assert [r["txn_id"] for r in store.page_after(dated, (5, "t04"), 3).collect()] == ["t05", "t06", "u"]


def test_latest_by(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), ("b", 1, None)], "k string, seq int, v string")
    assert {tuple(r) for r in store.latest_by(df, ["k"], ["seq"]).collect()} == {("a", 3, "y"), ("b", 1, None)}


def test_tag_stage_null_params(spark):
    df = spark.createDataFrame([("a", None), ("b", '{"n":256,"k":2,"q":3329,"eta":2}')], "txn_id string, lwe_params string")
    rows = {r["txn_id"]: r for r in store.tag_stage(df).collect()}
    assert rows["a"]["lwe_params"]["n"] is None and rows["b"]["lwe_params"]["q"] == 3329
    assert rows["a"]["pipeline_stage"] == "CASSANDRA_POLLED"


def test_export_has_no_payload(spark):
    assert "commitment_b64" not in EXPORT_COLS and not set(EXPORT_COLS) & set(FORBIDDEN_COLS)


def test_missing_shared_folder_is_an_error_on_a_cluster(spark):
    from tallywatch.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
