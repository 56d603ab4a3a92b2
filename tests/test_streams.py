import json

import pytest
from pyspark.sql import functions as F

from tallywatch.operators.privacy import sign
from tallywatch.operators.velocity import velocity
from tallywatch.sources.ledger import append_ledger, read_ledger
from tallywatch.sources.raw import WIRE_SCHEMA, file_stream, normalise_lenient, parse_raw
from tallywatch.streaming import live
from tallywatch.streaming.commits import commit_stream, ingest_message
from tallywatch.plans.streams import drain
from tallywatch.streaming.late import read_aside, read_windows, window_stream
from tallywatch.streaming.velocity import pending_velocity, velocity_batch, velocity_stream

NS = 10**9
DRAIN = {"availableNow": True}
KEY = b"stream-key"


def record(i, score=0.1, **more):
    return {"txn_id": f"T{i}", "account_id": f"ACC-{i % 3}", "amount_cents": 100 + i, "txn_type": "NEFT",
            "timestamp_ns": (1_704_067_200 + i * 60) * NS, "anomaly_score": score} | more


def put(path, name, *values):
    path.mkdir(exist_ok=True)
    lines = [v if isinstance(v, str) else json.dumps(v) for v in values]
    (path / f"{name}.txt").write_text("\n".join(lines) + "\n")


def text_feed(spark, path):
    return file_stream(spark, str(path), WIRE_SCHEMA, "text")


def run(spark, src, out, **options):
    query = commit_stream(text_feed(spark, src), str(out), KEY, str(out / "_checkpoint"), trigger=DRAIN, **options)
    query.awaitTermination()
    return query


def read(spark, out, name):
    return spark.read.parquet(str(out / name))


def test_commit_stream_fans_out_and_resumes(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    put(src, "a", *[record(i, i / 10) for i in range(10)])
    put(src, "b", "junk", record(10, amount_cents="ten"), record(11, 0.75))
    run(spark, src, out)
    assert read(spark, out, "committed").count() == 11
    assert sorted(r["txn_id"] for r in read(spark, out, "anomalies").collect()) == ["T11", "T8", "T9"]
    assert sorted(r["reject_reason"] for r in read(spark, out, "rejects").collect()) == ["BAD_AMOUNT", "MALFORMED_JSON"]
    counters = read(spark, out, "counters").agg(F.sum("processed"), F.sum("errors"), F.sum("signature_failures")).first()
    assert tuple(counters) == (11, 2, 0)
    # only the new file is read after a restart; the later write of T0 wins in the ledger
    put(src, "c", record(0, 0.99), record(12))
    run(spark, src, out)
    assert read(spark, out, "committed").count() == 13
    ledger = read_ledger(spark, str(out / "ledger"))
    assert ledger.count() == 12
    assert ledger.where("txn_id = 'T0'").first()["status"] == "QUARANTINED"
    assert read_ledger(spark, str(out / "ledger"), dedup=False).count() == 13


def test_signature_gate_in_stream(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    rows = normalise_lenient(parse_raw(spark.createDataFrame([(json.dumps(record(i)),) for i in range(3)], "value string")))
    signed = sign(rows, b"feed", ingest_message()).select("txn_id", "signature").collect()
    marks = {r["txn_id"]: r["signature"] for r in signed}
    put(src, "a", record(0, signature=marks["T0"]), record(1, signature=marks["T2"]), record(2))
    run(spark, src, out, sign_key=b"feed")
    assert [r["txn_id"] for r in read(spark, out, "committed").collect()] == ["T0"]
    assert {r["reject_reason"] for r in read(spark, out, "rejects").collect()} == {"BAD_SIGNATURE"}


def test_failing_hook_is_isolated(spark, tmp_path):
    src, out, seen = tmp_path / "src", tmp_path / "out", []
    put(src, "a", record(0, 0.9), record(1))

    def broken(frame, batch_id):
        raise ValueError("no")

    run(spark, src, out, on_committed=[broken, lambda f, b: seen.append(("c", f.count()))],
        on_anomaly=[lambda f, b: seen.append(("a", f.count()))])
    assert seen == [("c", 2), ("a", 1)]


def test_ledger_retry_replaces_its_batch(spark, tmp_path):
    from tallywatch.operators.commit import commit_table
    path = str(tmp_path / "ledger")
    rows = normalise_lenient(parse_raw(spark.createDataFrame([(json.dumps(record(i)),) for i in range(5)], "value string")))
    made = commit_table(rows, KEY)
    for _ in range(3):
        append_ledger(made, path, 0)
    assert read_ledger(spark, path, dedup=False).count() == 5
    append_ledger(made, path, 1)
    assert read_ledger(spark, path, dedup=False).count() == 10 and read_ledger(spark, path).count() == 5


TXN = "txn_id string, account_hash string, timestamp_ns bigint"


def parts(spark, path, *batches):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, TXN)
        frame.coalesce(1).write.mode("append").parquet(str(path / f"p{i}"))


def batchwise(spark, out, batches, delay_s=0, **options):
    step = velocity_batch(str(out), delay_s, **options)
    for i, rows in enumerate(batches):
        step(spark.createDataFrame(rows, TXN), i)


def emitted(spark, out, last, delay_s=0, **options):
    rest = pending_velocity(spark, str(out), last, delay_s, **options)
    done = [spark.read.parquet(str(out / "velocity"))] if (out / "velocity").exists() else []
    return sorted((r["txn_id"], r["velocity"]) for f in done + [rest] for r in f.select("txn_id", "velocity").collect())


def batch_truth(spark, batches, window_s=3600):
    rows = [r for b in batches for r in b]
    df = velocity(spark.createDataFrame(rows, TXN), key="account_hash", window_s=window_s)
    return sorted((r["txn_id"], r["velocity"]) for r in df.collect())


def test_velocity_stream_equals_batch(spark, tmp_path):
    rows = [(f"T{i}", "ABC"[i * 7 % 3], (1_704_067_200 + i * 400) * NS) for i in range(60)]
    batches = [rows[:20], rows[20:21], rows[21:50], rows[50:]]
    parts(spark, tmp_path / "src", *batches)
    out = tmp_path / "out"
    stream = velocity_stream(
        file_stream(spark, str(tmp_path / "src" / "*"), spark.createDataFrame(rows, TXN).schema), str(out),
        str(out / "_checkpoint"), 0, trigger=DRAIN)
    stream.awaitTermination()
    assert emitted(spark, out, stream.lastProgress["batchId"]) == batch_truth(spark, batches)


def test_velocity_out_of_order_within_delay(spark, tmp_path):
    rows = [(f"T{i}", "A", (1_704_067_200 + i * 100) * NS) for i in range(40)]
    mixed = rows[:10] + rows[14:20] + rows[10:14] + rows[20:]
    batches = [mixed[:16], mixed[16:24], mixed[24:]]
    batchwise(spark, tmp_path / "out", batches, delay_s=1000)
    assert emitted(spark, tmp_path / "out", 2, 1000) == batch_truth(spark, batches)
    assert spark.read.schema(TXN).parquet(str(tmp_path / "out" / "aside")).count() == 0


def test_velocity_late_rows_go_aside(spark, tmp_path):
    now = 1_704_067_200
    batches = [[("T0", "A", now * NS), ("T1", "A", (now + 10) * NS)], [("L", "A", (now + 5) * NS), ("T2", "A", (now + 20) * NS)]]
    batchwise(spark, tmp_path / "out", batches)
    late = spark.read.parquet(str(tmp_path / "out" / "aside"))
    assert [(r["txn_id"], r["aside_reason"]) for r in late.collect()] == [("L", "LATE")]
    assert emitted(spark, tmp_path / "out", 1) == [("T0", 1), ("T1", 2), ("T2", 3)]


def test_velocity_retry_and_empty_batch(spark, tmp_path):
    now = 1_704_067_200
    batches = [[(f"T{i}", "A", (now + i) * NS) for i in range(5)], [], [("T5", "A", (now + 9) * NS)]]
    step = velocity_batch(str(tmp_path / "out"), 0)
    for i in (0, 0, 1, 2, 2):
        step(spark.createDataFrame(batches[i], TXN), i)
    assert emitted(spark, tmp_path / "out", 2) == [(f"T{i}", i + 1) for i in range(6)]


def test_live_stats_update_mode(spark, tmp_path):
    src = tmp_path / "src"
    for i in range(3):
        frame = spark.createDataFrame([(f"T{j}", "VERIFIED" if j % 2 else "QUARANTINED", (100 + j // 4) * NS) for j in range(i * 4, i * 4 + 4)],
                                      "txn_id string, status string, timestamp_ns bigint")
        frame.coalesce(1).write.mode("append").parquet(str(src))
    rows = file_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    query = live.live_stats(rows, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("live").trigger(**DRAIN).start()
    query.awaitTermination()
    got = spark.sql("select unix_seconds(window.start) s, total, quarantined, verified from live order by 1").collect()
    assert [tuple(r) for r in got] == [(100, 4, 2, 2), (101, 4, 2, 2), (102, 4, 2, 2)]


def test_velocity_sets_null_and_future_times_aside(spark, tmp_path):
    now = 1_704_067_200
    good = [("T0", "A", now * NS), ("T1", "A", (now + 10) * NS), ("T2", "A", (now + 20) * NS)]
    batches = [[good[0], ("F", "A", (now + 10**9) * NS)], [good[1], ("N", "A", None)], [good[2]]]
    batchwise(spark, tmp_path / "out", batches, latest_ns=F.lit((now + 1000) * NS))
    aside = spark.read.parquet(str(tmp_path / "out" / "aside"))
    assert sorted((r["txn_id"], r["aside_reason"]) for r in aside.collect()) == [("F", "FUTURE"), ("N", "NO_TIME")]
    assert emitted(spark, tmp_path / "out", 2) == batch_truth(spark, [good])


def test_late_records_are_kept_and_counted(spark, tmp_path):
    src = tmp_path / "src"
    schema = "txn_id string, timestamp_ns bigint"
    for n, second in enumerate((1000, 5000, 6000, 1000, 5995, None, 9000)):
        ns = None if second is None else second * NS
        spark.createDataFrame([(f"T{n}", ns)], schema).coalesce(1).write.mode("append").parquet(str(src))
    rows = file_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    second = (F.col("timestamp_ns") / NS).cast("bigint").alias("s")
    out = str(tmp_path / "out")
    window_stream(rows, out, str(tmp_path / "ck"), lambda f: f.groupBy(second).agg(F.count("*").alias("n")), 10,
                  trigger=DRAIN).awaitTermination()
    got = {r["s"]: r["n"] for r in read_windows(spark, out, ["s"]).collect()}
    assert got == {1000: 1, 5000: 1, 6000: 1, 5995: 1, 9000: 1}
    assert sorted((r["txn_id"], r["aside_reason"]) for r in read_aside(spark, out).collect()) == [("T3", "LATE"), ("T5", "NO_TIME")]


def test_windows_are_right_over_many_batches(spark, tmp_path):
    """One file or four, in any order: the last value of each window is the count."""
    rows = [(f"T{i}", "VERIFIED" if i % 3 else "QUARANTINED", (i * 37 % 50) * NS) for i in range(60)]
    schema = "txn_id string, status string, timestamp_ns bigint"
    for name, size in (("one", 60), ("many", 15)):
        src = tmp_path / name
        for at in range(0, 60, size):
            spark.createDataFrame(rows[at:at + size], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = file_stream(spark, str(src), spark.read.parquet(str(src)).schema)
        done = drain(spark, live.live_stats(stream, "1 day", "10 seconds"), "windows", keys=["window"])
        got = sorted((r["s"], r["total"]) for r in done.select(F.unix_seconds("window.start").alias("s"), "total").collect())
        want = {}
        for _, _, ns in rows:
            want[ns // NS // 10 * 10] = want.get(ns // NS // 10 * 10, 0) + 1
        assert got == sorted(want.items())


def test_kafka_source_is_optional(spark):
    from tallywatch.sources.raw import kafka_stream
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_stream(spark, "nowhere:1", ["t"])


def test_stage_health_states(spark):
    """States by each limit on its own, unmeasured figures, and the state of the whole."""
    from tallywatch.streaming.health import overall, stage_health
    rows = [("fine", 0, 10, 499, 1000, 10, 9), ("errors", 0, 10, 1, 1000, 4, 4), ("errors", 1, 10, 1, 1000, 4, 6), ("slow", 0, 1, 500, 9000, 1, 0),
            ("busy", 0, 1, 401, 500, 1, 0), ("bare", 0, 7, None, None, None, None), ("edge", 0, 1, 400, 500, 1, 0)]
    schema = "stage string, batch_id long, input_rows long, batch_ms long, interval_ms long, processed long, errors long"
    progress = spark.createDataFrame(rows, schema)
    health = {r.stage: r for r in stage_health(progress).collect()}
    assert {s: r.status for s, r in health.items()} == {"fine": "ONLINE", "errors": "WARNING", "slow": "WARNING", "busy": "WARNING", "bare": "ONLINE", "edge": "ONLINE"}
    assert (health["errors"].batches, health["errors"].total, health["errors"].errors) == (2, 20, 10)
    assert overall(stage_health(progress)).first().overall == "DEGRADED"
    assert overall(stage_health(progress.where("stage IN ('fine', 'bare')"))).first().overall == "NOMINAL"
    assert overall(stage_health(progress.where("false"))).first().overall == "DEGRADED"
