import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tallywatch.operators.commit import bind, commit_batch, commit_table
from tallywatch.operators.envelope import check_counts, check_envelopes
from tallywatch.operators.resolve import resolve, resolve_errors, review_queue
from tallywatch.operators.status import batch_summary, status_stats
from tallywatch.operators.verify import error_text, lookup, reconcile, trace, verify_claims
from tallywatch.schemas import LEDGER_COLS, LWE_PARAMS
from tallywatch.sources.ledger import export_ledger

from . import lattice_model

KEY, SEED = b"master", bytes(32)
TXN = "txn_id string, amount_cents bigint, account_id string, txn_type string, timestamp_ns bigint, anomaly_score double"


def txns(spark, *rows):
    return spark.createDataFrame([(i, a, "ACC-" + i, "NEFT", 10**18, s) for i, a, s in rows], TXN)


@pytest.mark.parametrize("bits", [32, 64])
def test_lattice_matches_model(spark, bits):
    amounts = [0, 1, 9, -5, 500000, 2**31, 2**32, 2**32 + 1, 10**11]
    df = spark.createDataFrame([(f"T{i}", a) for i, a in enumerate(amounts)], "txn_id string, amount_cents bigint")
    for row in bind(df, KEY, "lwe", SEED, bits).collect():
        want = lattice_model.commit(SEED, KEY, row["txn_id"], row["amount_cents"], bits)
        assert base64.b64decode(row["commitment_b64"]) == want
        assert row["binding_hash"] == hashlib.sha3_256(want).hexdigest()
        assert row["size_kb"] == 1.5


def test_low_half_collides_only_in_compatible_mode(spark):
    df = spark.createDataFrame([("T", 5), ("T", 5 + 2**32)], "txn_id string, amount_cents bigint")
    assert bind(df, KEY, "lwe", SEED, 32).select("binding_hash").distinct().count() == 1
    assert bind(df, KEY, "lwe", SEED, 64).select("binding_hash").distinct().count() == 2


@pytest.mark.parametrize("binding", ["hmac", "lwe"])
def test_deterministic_and_sensitive(spark, binding):
    df = txns(spark, ("A", 100000, 0.1), ("B", 100000, 0.1), ("A", 200000, 0.1))
    first = [r["binding_hash"] for r in commit_table(df, KEY, binding).orderBy("txn_id", "binding_hash").collect()]
    again = [r["binding_hash"] for r in commit_table(df, KEY, binding).orderBy("txn_id", "binding_hash").collect()]
    assert first == again and len(set(first)) == 3 and all(len(h) == 64 for h in first)


@pytest.mark.parametrize("binding", ["hmac", "lwe"])
def test_verification(spark, binding):
    ledger = commit_table(txns(spark, ("A", 500000, 0.1), ("B", 7, 0.1), ("D", 1, 0.1)), KEY, binding)
    claims = spark.createDataFrame([("A", 500000), ("B", 999999), ("C", 1), ("A", 5)], "txn_id string, amount_cents bigint")
    got = verify_claims(claims, ledger, KEY, binding).withColumn("t", trace(binding)).withColumn("e", error_text())
    rows = {(r["txn_id"], r["amount_cents"]): r for r in got.collect()}
    outcomes = {k: r["outcome"] for k, r in rows.items()}
    assert outcomes == {("A", 500000): "VERIFIED", ("B", 999999): "FAILED", ("C", 1): "NOT_FOUND", ("A", 5): "FAILED"}
    steps = [s["step"] for s in rows["A", 500000]["t"]]
    assert steps == ["DERIVE_R", "LOAD_MATRIX_A", "COMPUTE_AS_E", "BITWISE_COMPARE", "RESULT"]
    assert rows["A", 500000]["t"][4]["status"] == "VERIFIED" and rows["B", 999999]["t"][4]["status"] == "FAILED"
    assert rows["C", 1]["t"] == [] and rows["C", 1]["e"] == "TXN C not found in ledger" and rows["A", 5]["e"] is None
    both = {tuple(r) for r in reconcile(claims, ledger, KEY, binding).collect()}
    assert ("D", "MISSING_CLAIM") in both and len(both) == 5


def test_ledger_row(spark):
    row = commit_table(txns(spark, ("A", 5, 0.75)), KEY, "lwe", "sha3").first()
    assert row.asDict().keys() == dict.fromkeys(LEDGER_COLS).keys()
    assert row["status"] == "QUARANTINED" and row["pii_bytes"] == 0
    assert row["account_hash"] == hashlib.sha3_256(b"ACC-A").hexdigest()
    assert tuple(row["lwe_params"]) == (256, 2, 3329, 2)


def test_bad_rows_do_not_stop_good_ones(spark):
    good = txns(spark, *[(f"G{i}", 50000 * (i + 1), 0.1) for i in range(10)])
    bad = spark.createDataFrame([
        ("", 1, "A", "NEFT", 1, 0.1), ("B", None, "A", "NEFT", 1, 0.1), ("C", 1, None, "NEFT", 1, 0.1),
        ("D", 1, "A", "BARTER", 1, 0.1), ("E", 1, "A", "NEFT", 1, float("nan")), ("F", 1, "A", "NEFT", 1, None),
    ], TXN)
    made, aside = commit_batch(good.unionByName(bad), KEY)
    assert made.count() == 10
    assert [r["reject_reason"] for r in aside.orderBy("txn_id").collect()] == [
        "MISSING_TXN_ID", "MISSING_AMOUNT", "MISSING_ACCOUNT", "UNKNOWN_TYPE", "MISSING_SCORE", "MISSING_SCORE"]


def test_status_stats(spark):
    ledger = commit_table(txns(spark, ("A", 1000, 0.1), ("B", 2000, 0.9), ("C", 3000, 0.1)), KEY)
    s = status_stats(ledger).first()
    assert (s["total"], s["verified"], s["quarantined"], s["chain_integrity_pct"]) == (3, 2, 1, 66.7)
    empty = status_stats(ledger.where("false")).first()
    assert (empty["total"], empty["chain_integrity_pct"]) == (0, 0.0)


def test_batch_summary(spark):
    df = spark.createDataFrame([("b1", "VERIFIED", 0), ("b1", "REJECTED", 4 * 10**9), ("b2", "QUARANTINED", 5)],
                               "batch_id string, status string, timestamp_ns bigint")
    one, two = batch_summary(df).orderBy("batch_id").collect()
    assert tuple(one) == ("b1", 2, 1, 0, 1, 4000.0, 0.5, 50.0)
    assert tuple(two) == ("b2", 1, 0, 1, 0, 0.0, 1.0, 0.0)


def test_lookup(spark):
    ledger = commit_table(txns(spark, ("Ab", 1, 0.1)), KEY)
    ids = spark.createDataFrame([("aB",), ("zz",)], "txn_id string")
    assert {(r["txn_id"], r["found"]) for r in lookup(ids, ledger, True).collect()} == {("aB", True), ("zz", False)}
    assert not any(r["found"] for r in lookup(ids, ledger).collect())


def test_resolve(spark):
    ledger = commit_table(txns(spark, *[(i, 1, 0.9) for i in "ABCD"]), KEY)
    acts = spark.createDataFrame([
        ("A", "AUTHORIZE", "x", 1), ("B", "AUTHORIZE", "x", 1), ("B", "TERMINATE", "y", 2), ("C", "FOO", "x", 1),
        ("Z", "TERMINATE", "x", 1), ("A", "FOO", "x", 9), ("D", None, "x", 1),
    ], "txn_id string, action string, resolved_by string, action_seq int")
    done = {r["txn_id"]: r["status"] for r in resolve(ledger, acts).collect()}
    assert done == {"A": "VERIFIED", "B": "REJECTED", "C": "QUARANTINED", "D": "QUARANTINED"}
    assert {r["txn_id"] for r in review_queue(resolve(ledger, acts)).collect()} == {"C", "D"}
    errors = sorted((r["txn_id"], r["code"], r["detail"]) for r in resolve_errors(ledger, acts).collect())
    assert errors == [("A", 400, "Unknown action: FOO"), ("C", 400, "Unknown action: FOO"),
                      ("D", 400, "Unknown action: None"), ("Z", 404, "TXN Z not found")]


def envelope(spark, binding, pii=0, params=(256, 2, 3329, 2)):
    schema = f"txn_id string, binding_hash string, pii_bytes int, lwe_params {LWE_PARAMS.simpleString()}"
    return check_envelopes(spark.createDataFrame([("T", binding, pii, params)], schema)).first()


@pytest.mark.parametrize("kwargs, failed", [
    (dict(binding="a" * 64), set()), (dict(binding="a" * 64, pii=None), set()),
    (dict(binding="A" * 64), {"BINDING_HASH_FORMAT"}), (dict(binding="a" * 63), {"BINDING_HASH_FORMAT"}),
    (dict(binding=None), {"BINDING_HASH_FORMAT"}), (dict(binding="g" * 64), {"BINDING_HASH_FORMAT"}),
    (dict(binding="a" * 64, pii=3), {"PII_ASSERTION"}), (dict(binding="a" * 64, params=None), {"LWE_PARAMS"}),
    (dict(binding="a" * 64, params=(256, 2, 7681, 2)), {"LWE_PARAMS"}),
    (dict(binding="a" * 64, params=(None, 2, 3329, 2)), {"LWE_PARAMS"}),
])
def test_envelopes(spark, kwargs, failed):
    row = envelope(spark, **kwargs)
    assert {c["check"] for c in row["checks"] if c["status"] == "FAIL"} == failed
    assert row["overall"] == ("FAIL" if failed else "INCOMPLETE")
    assert row["checks"][0]["status"] == "NOT_CHECKED"


@pytest.mark.parametrize("valid, status, overall", [
    (True, "PASS", "PASS"), (False, "FAIL", "FAIL"), (None, "NOT_CHECKED", "INCOMPLETE")])
def test_signature_check_follows_the_verified_signature(spark, valid, status, overall):
    exported = export_ledger(commit_table(txns(spark, ("A", 5, 0.1)), KEY)).withColumn("signature_valid", F.lit(valid).cast("boolean"))
    row = check_envelopes(exported).first()
    assert row["checks"][0]["status"] == status and row["overall"] == overall


def test_null_amounts_do_not_touch_other_rows(spark):
    big = 2**53 + 1
    rows = [("A", big), ("B", None), (None, 4)]
    for binding in ("hmac", "lwe"):
        alone = bind(spark.createDataFrame([("A", big)], "txn_id string, amount_cents bigint"), KEY, binding).first()
        mixed = bind(spark.createDataFrame(rows, "txn_id string, amount_cents bigint").coalesce(1), KEY, binding).collect()
        found = {r["txn_id"]: r for r in mixed}
        assert found["A"]["binding_hash"] == alone["binding_hash"] and found["A"]["amount_cents"] == big
        assert found["B"]["binding_hash"] is None and found["B"]["amount_cents"] is None


def test_envelope_of_export_and_fallback_name(spark):
    exported = export_ledger(commit_table(txns(spark, ("A", 5, 0.1)), KEY))
    assert check_envelopes(exported).first()["overall"] == "INCOMPLETE"
    renamed = exported.withColumnRenamed("binding_hash", "commitment")
    assert check_envelopes(renamed).first()["overall"] == "INCOMPLETE"
    assert {tuple(r) for r in check_counts(check_envelopes(exported)).collect()} == {
        ("SIGNATURE", "NOT_CHECKED", 1),
        *((c, "PASS", 1) for c in ("PII_ASSERTION", "BINDING_HASH_FORMAT", "LWE_PARAMS"))}
