"""Streams over the given tables, drained and read back."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from ..functions.risk import status_of
from ..operators.privacy import pseudonymise
from ..operators.status import observe_ingest
from ..session import work_dir
from ..functions.timeparts import HOUR_NS, floor_div
from ..sources.ledger import append_ledger, latest_by, read_ledger
from ..sources.raw import file_stream
from ..streaming import live
from ..streaming.commits import commit_stream
from ..streaming.health import overall, progress_rows, stage_health
from ..streaming.late import read_aside, read_windows, window_stream
from ..streaming.sinks import parquet_sink
from ..streaming.velocity import pending_velocity, velocity_stream
from . import fixtures as fx
from .registry import query
from .sqltext import BINDING, STATUS, views

DRAIN = {"availableNow": True}

RESUME_AT = 1704844800_000_000_000


#: Rows of a file of a delivery; a larger delivery has several files, which are read as one batch, a task each.
FILE_ROWS = 100_000


def deliver(rows, name, parts, n):
    """Rows as a stream of deliveries, one batch after another: ``parts`` are conditions on the rows, ``n`` is their number."""
    spark = rows.sparkSession
    path, files = work_dir(spark, name), max(1, -(-n // (4 * FILE_ROWS)))
    for part in parts:
        chosen = rows.where(part)
        (chosen.coalesce(1) if files == 1 else chosen.repartition(files)).write.mode("append").parquet(path)
    return file_stream(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=str(files))


def quarters(rows, key, delayed):
    """Conditions that deliver rows in four parts by ``key``, the ``delayed`` ones a part too late; the last takes all left. Their number."""
    (low, mid, high), n = rows.agg(F.percentile_approx(key, [0.25, 0.5, 0.75]), F.count("*")).first()
    place = F.when(F.col(key) <= low, 0).when(F.col(key) <= mid, 1).when(F.col(key) <= high, 2).otherwise(3)
    place = F.coalesce(place + F.when(delayed, 1).otherwise(0), F.lit(0))
    return [place == i for i in range(5)], n


def event_stream(spark, sf):
    """The event table, a file or a folder, as a stream of five deliveries; every fifth event comes one too late."""
    events = fx.table(spark, sf, "events")
    return fx.events_as_raw(deliver(events, "event-files", *quarters(events, "event_id", F.col("event_id") % 5 == 0)))


def feed_stream(spark, sf):
    raw = event_stream(spark, sf)
    return raw.select(F.to_json(F.struct(*[c for c in raw.columns if c != "k"])).alias("value"))


#: Longer than the tables' time span: these queries count every row, however late.
SPAN = "3650 days"
SPAN_S = 3650 * 86400


def drain(spark, stream, name, mode="update", keys=None):
    """Run a stream to the end of its input and read back what it wrote; of updated rows the last per key."""
    path = work_dir(spark, name)
    write = parquet_sink(path)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
    run.foreachBatch(lambda batch, batch_id: write("rows", batch, batch_id)).trigger(**DRAIN).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows if keys is None else latest_by(rows, keys, ["batch_id"])


def envelope_stream(spark, sf):
    rows = fx.envelopes(spark, sf)
    return deliver(rows, "envelopes", *quarters(rows, "timestamp_ns", F.col("timestamp_ns") % 7 == 0))


@query(f"""{views('raw')}
    SELECT 'committed' AS output, txn_id, {BINDING} AS binding_hash, {STATUS} AS status FROM raw
    UNION ALL SELECT 'anomalies', txn_id, {BINDING}, {STATUS} FROM raw WHERE anomaly_score >= 0.75
    UNION ALL SELECT 'ledger', txn_id, {BINDING}, {STATUS} FROM raw""")
def commit_from_feed(spark, sf):
    """Feed to ledger, committed and anomaly outputs."""
    out = work_dir(spark, "commits")
    commit_stream(feed_stream(spark, sf), out, fx.KEY, f"{out}/_checkpoint", trigger=DRAIN).awaitTermination()
    frames = {name: spark.read.parquet(f"{out}/{name}") for name in ("committed", "anomalies")}
    frames["ledger"] = read_ledger(spark, f"{out}/ledger", columns=["txn_id", "binding_hash", "status"])
    rows = [f.select(F.lit(name).alias("output"), "txn_id", "binding_hash", "status") for name, f in frames.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{views('checks')} SELECT "check", status, count(*) AS n FROM checks
    WHERE txn_id IN (SELECT txn_id FROM envelopes WHERE coalesce(pii_bytes, 0) = 0) GROUP BY ALL""")
def verify_from_stream(spark, sf):
    """Envelope checks on a stream of committed records."""
    checked = live.verify_records(envelope_stream(spark, sf))
    rows = drain(spark, checked.select("txn_id", "checks"), "checked", "append")
    return rows.select(F.explode("checks").alias("c")).groupBy(
        F.col("c.check").alias("check"), F.col("c.status").alias("status")).agg(F.count("*").alias("n"))


@query(f"""{views('checks')} SELECT timestamp_ns // 86400000000000 AS day, "check", status, count(*) AS n FROM checks GROUP BY ALL""")
def check_counts_from_stream(spark, sf):
    """Check outcomes per day, kept by the stream."""
    counts = live.check_count_stream(envelope_stream(spark, sf), SPAN, "1 day")
    day = F.expr("unix_seconds(window.start) div 86400").alias("day")
    return drain(spark, counts, "check-counts", keys=["window", "check", "status"]).select(day, "check", "status", "n")


@query(f"""{views('raw')} SELECT timestamp_ns // 3600000000000 AS hour, count(*) AS total,
    count(*) FILTER (anomaly_score >= 0.75) AS quarantined, count(*) FILTER (anomaly_score < 0.75) AS verified
    FROM raw GROUP BY 1""")
def live_stats(spark, sf):
    """Totals per hour of event time, kept by the stream."""

    rows = event_stream(spark, sf).withColumn("status", status_of(F.col("anomaly_score")))
    stats = drain(spark, live.live_stats(rows, SPAN, "1 hour"), "live", keys=["window"])
    return stats.select(
        F.expr("unix_seconds(window.start) div 3600").alias("hour"), "total", "quarantined", "verified"
    )


@query(f"{views('counted')} SELECT txn_id, velocity FROM counted")
def velocity_from_stream(spark, sf):
    """Exact trailing counts from the stream, equal to the batch operator."""
    out = work_dir(spark, "velocity")
    slim = pseudonymise(event_stream(spark, sf)).select("txn_id", "account_hash", "timestamp_ns")
    stream = velocity_stream(slim, out, f"{out}/_checkpoint", SPAN_S, trigger=DRAIN)
    stream.awaitTermination()
    return pending_velocity(spark, out, stream.lastProgress["batchId"], SPAN_S).select("txn_id", "velocity")


@query(f"{views('counted')} SELECT txn_id, velocity FROM counted")
def velocity_from_ordered_stream(spark, sf):
    """The same from a feed in order: most rows are given out while the stream runs, the rest is pending."""
    out = work_dir(spark, "velocity")
    events = fx.table(spark, sf, "events")
    parts, n = quarters(events, "event_id", F.lit(False))
    slim = pseudonymise(fx.events_as_raw(deliver(events, "event-files", parts[:4], n))).select("txn_id", "account_hash", "timestamp_ns")
    stream = velocity_stream(slim, out, f"{out}/_checkpoint", 60, trigger=DRAIN)
    stream.awaitTermination()
    done = spark.read.parquet(f"{out}/velocity").select("txn_id", "velocity")
    rest = pending_velocity(spark, out, stream.lastProgress["batchId"], 60).select("txn_id", "velocity")
    return done.unionByName(rest)


LATE_S = 3600


@query(f"""{views('raw')}, mark AS (SELECT max(timestamp_ns) - {LATE_S * 10**9} AS ns FROM raw WHERE k <> 13)
    SELECT 'window' AS kind, timestamp_ns // 3600000000000 AS hour, count(*) AS n FROM raw
    WHERE k <> 13 OR timestamp_ns >= (SELECT ns FROM mark) GROUP BY 2
    UNION ALL SELECT 'LATE', timestamp_ns // 3600000000000, count(*) FROM raw
    WHERE k = 13 AND timestamp_ns < (SELECT ns FROM mark) GROUP BY 2""")
def late_rows_from_stream(spark, sf):
    """Rows held back to the end of the feed: hourly counts, and the rows too late for them, none lost."""
    out = work_dir(spark, "late")
    raw = fx.raw_txns(spark, sf).select("txn_id", "timestamp_ns", "k")
    parts, n = quarters(raw, "timestamp_ns", F.lit(False))
    parts = [p & (F.col("k") != 13) for p in parts[:4]] + [F.col("k") == 13]
    hour = floor_div(F.col("timestamp_ns"), HOUR_NS).alias("hour")
    window_stream(
        deliver(raw, "held-back", parts, n), out, f"{out}/_checkpoint", lambda rows: rows.groupBy(hour).agg(F.count("*").alias("n")),
        LATE_S, trigger=DRAIN,
    ).awaitTermination()
    late = read_aside(spark, out).groupBy(F.col("aside_reason").alias("kind"), hour).agg(F.count("*").alias("n"))
    counted = read_windows(spark, out, ["hour"]).select(F.lit("window").alias("kind"), "hour", "n")
    return counted.unionByName(late.select("kind", "hour", "n"))


@query(f"""{views('raw')} SELECT account_id, start_min, count(*) AS n FROM (
    SELECT account_id, (timestamp_ns // 1800000000000 - unnest(range(2))) * 30 AS start_min FROM raw) GROUP BY ALL""")
def velocity_windows_from_stream(spark, sf):
    """Transactions per account and sliding hour, every half hour."""
    counts = live.velocity_windows(event_stream(spark, sf), SPAN, "account_id", "1 hour", "30 minutes")
    start = F.expr("unix_seconds(window.start) div 60").alias("start_min")
    return drain(spark, counts, "velocity-windows", keys=["account_id", "window"]).select("account_id", start, "n")


@query(f"""{views('ledger')} SELECT txn_id, binding_hash, 'CASSANDRA_POLLED' AS pipeline_stage FROM ledger""")
def ledger_tail(spark, sf):
    """The ledger's folder followed as a stream from its beginning."""
    return _tail(spark, sf, None)


@query(f"""{views('ledger')} SELECT txn_id, binding_hash, 'CASSANDRA_POLLED' AS pipeline_stage FROM ledger
    WHERE timestamp_ns > {RESUME_AT}""")
def ledger_tail_from(spark, sf):
    """The same from a given position on: only rows after it are fed."""
    return _tail(spark, sf, RESUME_AT)


def _tail(spark, sf, after_ns):
    path = work_dir(spark, "ledger")
    append_ledger(fx.ledger(spark, sf), path)
    schema = spark.read.parquet(path).schema
    rows = live.ledger_feed(file_stream(spark, path, schema, maxFilesPerTrigger="16"), after_ns)
    return drain(spark, rows, "tail", "append").select("txn_id", "binding_hash", "pipeline_stage")


@query(f"""{views('raw')} SELECT 'committed' AS hook, count(*) AS n FROM raw
    UNION ALL SELECT 'anomaly', count(*) FROM raw WHERE anomaly_score >= 0.75""")
def hook_counts(spark, sf):
    """User hooks on the ledger stream, one of which always fails: the others see every row."""
    out = work_dir(spark, "hooks")
    write = parquet_sink(out)

    def broken(frame, batch_id):
        raise RuntimeError("a hook that fails")

    def note(name):
        return lambda frame, batch_id: write(name, frame.select("txn_id"), batch_id)

    logging.getLogger("tallywatch.streaming.sinks").setLevel(logging.CRITICAL)
    commit_stream(
        feed_stream(spark, sf), f"{out}/run", fx.KEY, f"{out}/_checkpoint", trigger=DRAIN,
        on_committed=[broken, note("committed")], on_anomaly=[note("anomaly")],
    ).awaitTermination()
    frames = [spark.read.parquet(f"{out}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("hook"), "n")
              for n in ("committed", "anomaly")]
    return frames[0].unionByName(frames[1])


@query(f"""{views('raw')} SELECT 'ingest' AS stage, count(*) AS total, count(*) FILTER (k = 13) AS errors,
    CASE WHEN count(*) FILTER (k = 13) < 10 THEN 'ONLINE' ELSE 'WARNING' END AS status,
    CASE WHEN count(*) FILTER (k = 13) < 10 THEN 'NOMINAL' ELSE 'DEGRADED' END AS overall FROM raw
    UNION ALL SELECT 'statistics', count(*), 0, 'ONLINE', CASE WHEN count(*) FILTER (k = 13) < 10 THEN 'NOMINAL' ELSE 'DEGRADED' END FROM raw""")
def stage_states(spark, sf):
    """States of two stages of a drained run, from their queries' progress and observed counters."""
    raw = event_stream(spark, sf).withColumn("reject_reason", F.when(F.col("k") == 13, F.lit("BAD_SIGNATURE")))
    out = work_dir(spark, "health")
    write = parquet_sink(out)
    stages = {}
    for name, rows in (("ingest", observe_ingest(raw, "ingest")), ("statistics", raw.select("txn_id", "timestamp_ns"))):
        run = rows.writeStream.option("checkpointLocation", f"{out}/_checkpoint-{name}")
        to = lambda batch, batch_id, name=name: write(name, batch.select("txn_id"), batch_id)
        stages[name] = run.foreachBatch(to).trigger(**DRAIN).start()
        stages[name].awaitTermination()
    # how long a batch takes here is not the table's matter: an hour is allowed
    health = stage_health(progress_rows(spark, stages), most_batch_ms=3_600_000)
    state = overall(health).first()["overall"]
    return health.select("stage", "total", "errors", "status", F.lit(state).alias("overall"))
