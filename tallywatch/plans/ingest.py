"""Ingest, privacy and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import status_of
from ..functions.timeparts import date_bucket
from ..operators import privacy
from ..operators.commit import bind, commit_batch, commit_table, keyed_nonce
from ..operators.envelope import check_counts, check_envelopes
from ..operators.resolve import resolve, resolve_errors, review_queue
from ..operators.status import batch_summary, ingest_counts, status_stats
from ..operators.verify import error_text, lookup, reconcile, trace, verify_claims
from ..session import work_dir
from ..sources import ledger as store
from ..sources.raw import (
    ANOMALY_TOPIC, COMMITTED_TOPIC, normalise_lenient, normalise_strict, parse_raw, route, split_rejects, union_topics,
)
from ..streaming.commits import fan_out, ingest_message
from . import fixtures as fx
from .registry import query
from .sqltext import BINDING, PARAMS_JSON, mac, percent, views

RAW_OUT = ["txn_id", "account_id", "counterparty_id", "amount_cents", "currency", "txn_type", "timestamp_ns",
           "anomaly_score"]
EXPORT_SQL = ("txn_id, binding_hash, size_kb, lwe_params, timestamp_ns, pii_bytes, account_hash, txn_type, status, "
              "anomaly_score")


def flat(df):
    return df.withColumn("lwe_params", F.to_json("lwe_params"))


@query(f"{views('raw')} SELECT {', '.join(RAW_OUT)}, CAST(k AS VARCHAR) AS k FROM raw")
def parse_raw_json(spark, sf):
    """Topic text to typed transactions."""
    good, _ = split_rejects(normalise_lenient(parse_raw(fx.event_feed(spark, sf))))
    return good.select(*RAW_OUT, F.col("metadata")["k"].alias("k"))


@query("""
    SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS txn_id, 'CUST-' || CAST(o_custkey AS VARCHAR) AS account_id,
           '' AS counterparty_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, 'INR' AS currency,
           o_orderpriority AS txn_type, epoch_us(o_orderdate) * 1000 AS timestamp_ns, 0.0::DOUBLE AS anomaly_score
    FROM orders""")
def normalise_other_spelling(spark, sf):
    """transaction_id, amount and type instead of the usual names."""
    good, _ = split_rejects(normalise_lenient(parse_raw(fx.order_feed(spark, sf))))
    return good.select(*RAW_OUT)


@query("""
    SELECT 'CUST-' || CAST(o_custkey AS VARCHAR) AS account_id, '' AS counterparty_id, 0::BIGINT AS amount_cents,
           'INR' AS currency, 'RTGS' AS txn_type, epoch_us(o_orderdate) * 1000 AS timestamp_ns, count(*) AS ids
    FROM orders GROUP BY ALL""")
def normalise_model_defaults(spark, sf):
    """Missing fields get model defaults, a missing id a hash of the record: as many ids as records."""
    good, _ = split_rejects(normalise_strict(parse_raw(fx.order_feed(spark, sf))))
    return good.groupBy("account_id", "counterparty_id", "amount_cents", "currency", "txn_type", "timestamp_ns").agg(
        F.count_distinct("txn_id").alias("ids"))


@query("""
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1""")
def idless_rows_kept(spark, sf):
    """Records without any id, committed and read back from the ledger: none overwrites another."""
    path = work_dir(spark, "idless")
    good, _ = split_rejects(normalise_lenient(parse_raw(fx.idless_feed(spark, sf))))
    store.append_ledger(commit_table(good, fx.KEY), path, 0)
    held = store.read_ledger(spark, path, columns=["txn_id", "date_bucket"])
    return held.groupBy(F.col("date_bucket").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""
    SELECT 'usable' AS side, 'none' AS reason, count(*) AS n FROM events
    UNION ALL SELECT 'rejected', 'MALFORMED_JSON', count(*) FROM conversations""")
def bad_record_split(spark, sf):
    """A feed mixed with chat text: usable and rejected rows."""
    feed = fx.event_feed(spark, sf).unionByName(fx.chat_feed(spark, sf))
    good, bad = split_rejects(normalise_lenient(parse_raw(feed)))
    kept = good.select(F.lit("usable").alias("side"), F.lit("none").alias("reason"))
    lost = bad.select(F.lit("rejected").alias("side"), F.col("reject_reason").alias("reason"))
    return kept.unionByName(lost).groupBy("side", "reason").agg(F.count("*").alias("n"))


@query(f"""
    {views('raw')} SELECT (SELECT count(*) FROM raw WHERE k <> 34) AS processed,
    (SELECT count(*) FROM conversations) AS errors, (SELECT count(*) FROM raw WHERE k = 34) AS signature_failures""")
def ingest_counters(spark, sf):
    """Processed rows, errors and signature failures of one run."""
    rows = normalise_lenient(parse_raw(fx.event_feed(spark, sf).unionByName(fx.chat_feed(spark, sf))))
    signed = privacy.sign(rows, fx.SIGN_KEY, ingest_message())
    forged = F.when(F.col("metadata")["k"] == "34", F.lit("0")).otherwise(F.col("signature"))
    checked = privacy.with_valid_signature(signed.withColumn("signature", forged), fx.SIGN_KEY, ingest_message())
    reason = F.coalesce("reject_reason", F.when(~F.col("signature_valid"), F.lit("BAD_SIGNATURE")))
    return ingest_counts(checked.withColumn("reject_reason", reason))


@query(f"""
    {views('ledger')} SELECT 'committed' AS topic, {EXPORT_SQL} FROM ledger
    UNION ALL SELECT 'anomalies', {EXPORT_SQL} FROM ledger WHERE anomaly_score >= 0.75""")
def anomaly_fan_out(spark, sf):
    """Every record is committed; high scores also go to the anomalies."""
    return flat(union_topics(fan_out(store.export_ledger(fx.ledger(spark, sf)))))


@query(f"""
    {views('ledger')} SELECT 'committed' AS topic, status, count(*) AS n FROM ledger GROUP BY ALL
    UNION ALL SELECT 'anomalies', status, count(*) FROM ledger WHERE anomaly_score >= 0.75 GROUP BY ALL""")
def route_topics(spark, sf):
    """Two topics read as one feed and told apart again."""
    outputs = fan_out(store.export_ledger(fx.ledger(spark, sf)))
    both = union_topics({COMMITTED_TOPIC: outputs["committed"], ANOMALY_TOPIC: outputs["anomalies"]})
    parts = route(both, [COMMITTED_TOPIC, ANOMALY_TOPIC])
    named = {"committed": parts[COMMITTED_TOPIC], "anomalies": parts[ANOMALY_TOPIC]}
    return union_topics(named).groupBy("topic", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def last_write_wins(spark, sf):
    """Repeated keys keep their last row."""
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_partkey",
        "l_suppkey", "l_extendedprice",
    )
    return store.latest_by(rows, ["l_orderkey", "l_linenumber"], ["shipped", "l_partkey", "l_suppkey", "l_extendedprice"])


@query(f"""
    {views('ledger')} SELECT CAST(make_timestamp(timestamp_ns // 1000) AS DATE)::VARCHAR AS day, count(*) AS n,
    count(DISTINCT txn_id) AS txns, CAST(sum(timestamp_ns // 1000000000) AS BIGINT) AS seconds, min(binding_hash) AS low_hash
    FROM ledger GROUP BY 1""")
def ledger_round_trip(spark, sf):
    """Written twice by day under batch ids, one batch retried; read back, last write per id."""
    path = work_dir(spark, "ledger")
    rows = fx.ledger(spark, sf)
    store.append_ledger(rows.withColumn("status", F.lit("PENDING")), path, 0)
    store.append_ledger(rows, path, 1)
    store.append_ledger(rows, path, 1)
    resolved = store.read_ledger(spark, path, columns=["txn_id", "timestamp_ns", "binding_hash", "date_bucket"])
    # grouped by the column that the resolved rows are dealt out by, so that distinct ids need no shuffle of their own
    days = resolved.groupBy("date_bucket").agg(
        F.count("*").alias("n"), F.count_distinct("txn_id").alias("txns"),
        F.sum(F.expr("timestamp_ns div 1000000000")).alias("seconds"), F.min("binding_hash").alias("low_hash"),
    )
    return days.select(F.col("date_bucket").cast("string").alias("day"), "n", "txns", "seconds", "low_hash")


@query(f"""
    {views('ledger')} SELECT CAST(make_timestamp(timestamp_ns // 1000) AS DATE)::VARCHAR AS day, status, count(*) AS n
    FROM ledger GROUP BY ALL""")
def vault_archive(spark, sf):
    """Append-only archive by day."""
    path = work_dir(spark, "vault")
    store.write_vault(fx.ledger(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("date_bucket").cast("string").alias("day"), "status").agg(F.count("*").alias("n"))


PAGE_START = 1704844800_000_000_000


@query(f"""
    {views('gapped')} SELECT txn_id, timestamp_ns, binding_hash, 'CASSANDRA_POLLED' AS pipeline_stage FROM gapped
    WHERE timestamp_ns >= {PAGE_START} ORDER BY timestamp_ns, txn_id LIMIT 500""")
def incremental_page(spark, sf):
    """The next 500 ledger rows after a cursor, tagged with their stage."""
    held = store.read_ledger(
        spark, fx.stored_ledger(spark, sf), columns=["txn_id", "timestamp_ns", "binding_hash", "date_bucket"])
    page = store.page_after(held, (PAGE_START, ""), 500)
    return store.tag_stage(page).select("txn_id", "timestamp_ns", "binding_hash", "pipeline_stage")


@query(f"""
    {views('raw')} SELECT txn_id, CASE WHEN k < 50 THEN 256 END AS n, CASE WHEN k < 50 THEN 3329 END AS q,
    'CASSANDRA_POLLED' AS pipeline_stage FROM raw""")
def stage_tag_params(spark, sf):
    """Parameter text parsed, absent text as an empty set."""
    text = F.when(F.col("k") < 50, F.lit(PARAMS_JSON))
    rows = store.tag_stage(fx.raw_txns(spark, sf).select("txn_id", text.alias("lwe_params")))
    return rows.select("txn_id", "lwe_params.n", "lwe_params.q", "pipeline_stage")


@query(f"{views('ledger')} SELECT {EXPORT_SQL} FROM ledger")
def ledger_export(spark, sf):
    """All records, listed columns only."""
    return flat(store.export_ledger(fx.ledger(spark, sf)))


@query(f"""
    {views('hashed')} SELECT txn_id, account_hash, counterparty_hash, currency, txn_type, timestamp_ns,
    CASE WHEN anomaly_score >= 0.75 THEN 'QUARANTINED' ELSE 'VERIFIED' END AS status, anomaly_score,
    {BINDING} AS commitment_binding, {mac(fx.SIGN_KEY, f"txn_id || '|' || {BINDING}")} AS signature_b64, 0 AS pii_bytes
    FROM hashed""")
def ledger_export_signed(spark, sf):
    """The wider export: both parties' hashes, binding and signature."""
    hashed = fx.hashed_txns(spark, sf)
    bound = bind(hashed, fx.KEY).withColumn("status", status_of(F.col("anomaly_score")))
    signed = privacy.sign(bound, fx.SIGN_KEY)
    return store.export_ledger_v2(signed.withColumnsRenamed({
        "binding_hash": "commitment_binding", "signature": "signature_b64"
    }))


@query(f"{views('hashed')} SELECT txn_id, account_hash, counterparty_hash FROM hashed")
def pseudonymise(spark, sf):
    return fx.hashed_txns(spark, sf).select("txn_id", "account_hash", "counterparty_hash")


@query()
def pseudonymise_sha3(spark, sf):
    """SHA3-256 pseudonyms over Arrow."""
    hashed = privacy.pseudonymise(fx.raw_txns(spark, sf), "sha3")
    return hashed.select("txn_id", "account_hash", "counterparty_hash")


@query(f"""{views('hashed')} SELECT txn_id, currency, txn_type, timestamp_ns, anomaly_score, k, account_hash,
    counterparty_hash FROM hashed""")
def redact(spark, sf):
    """No raw id, amount or metadata left."""
    return privacy.redact(fx.hashed_txns(spark, sf))


@query(f"""{views('envelopes')} SELECT coalesce(pii_bytes, 0) = 0 AS kept, count(*) AS n FROM envelopes GROUP BY ALL""")
def pii_assertion(spark, sf):
    """Records that declare personal bytes are dropped and counted."""
    clean, dirty = privacy.split_pii(fx.envelopes(spark, sf))
    both = clean.select(F.lit(True).alias("kept")).unionByName(dirty.select(F.lit(False).alias("kept")))
    return both.groupBy("kept").agg(F.count("*").alias("n"))


@query(f"""{views('raw')} SELECT 'memo' AS "column", account_id AS value, count(*) AS n FROM raw WHERE k = 21
    GROUP BY account_id UNION ALL SELECT 'detail', counterparty_id, count(*) FROM raw WHERE k = 34 GROUP BY ALL""")
def leaked_id_audit(spark, sf):
    """Finds the raw account ids that slipped into the text of an export's memo and into a nested note."""
    raw = fx.raw_txns(spark, sf)
    memo = F.concat(F.lit("paid by "), F.col("account_id"), F.lit(": 4711"))
    note = F.concat_ws("", F.lit("to:"), F.col("counterparty_id"))
    export = privacy.pseudonymise(raw).select(
        "txn_id", "account_hash", "counterparty_hash", "txn_type", "currency",
        F.when(F.col("k") == 21, memo).otherwise(F.lit("ok")).alias("memo"),
        F.struct(F.lit("desk").alias("by"), F.array(F.when(F.col("k") == 34, note)).alias("notes")).alias("detail"),
    )
    return privacy.leaked_ids(export, raw)


@query(f"""{views('raw')} SELECT txn_id, 'memo' AS "column" FROM raw WHERE k = 21
    UNION ALL SELECT txn_id, 'detail' FROM raw WHERE k = 34
    UNION ALL SELECT txn_id, 'k' FROM raw WHERE k = amount_cents""")
def leaked_amount_audit(spark, sf):
    """Finds exported values that show the transaction's own amount."""
    raw = fx.raw_txns(spark, sf)
    export = raw.select(
        "txn_id", "txn_type", "timestamp_ns", "k",
        F.when(F.col("k") == 21, F.concat(F.lit("paid "), F.col("amount_cents").cast("string"), F.lit(" cents"))).alias("memo"),
        F.struct(F.when(F.col("k") == 34, F.col("amount_cents")).alias("sum")).alias("detail"),
    )
    return privacy.leaked_amounts(export, raw)


@query(f"{views('ledger')} SELECT txn_id, binding_hash, NOT txn_id LIKE '%7' AS signature_valid FROM ledger")
def signature_gate(spark, sf):
    """Signatures moved to another binding do not verify."""
    signed = privacy.sign(fx.ledger(spark, sf), fx.SIGN_KEY)
    swapped = F.when(F.col("txn_id").endswith("7"), F.reverse("signature")).otherwise(F.col("signature"))
    checked = privacy.with_valid_signature(signed.withColumn("signature", swapped), fx.SIGN_KEY)
    return checked.select("txn_id", "binding_hash", "signature_valid")


@query(f'{views("checks")} SELECT txn_id, "check", status, detail FROM checks')
def envelope_checks(spark, sf):
    """Four checks per record."""
    checked = check_envelopes(fx.envelopes(spark, sf))
    return checked.select("txn_id", F.explode("checks").alias("c")).select("txn_id", "c.*")


@query(f"""{views('checks')} SELECT txn_id, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS overall
    FROM checks GROUP BY txn_id""")
def envelope_overall(spark, sf):
    return check_envelopes(fx.envelopes(spark, sf)).select("txn_id", "overall")


@query(f'{views("checks")} SELECT "check", status, count(*) AS n FROM checks GROUP BY ALL')
def check_counters(spark, sf):
    """Passes and failures per check."""
    return check_counts(check_envelopes(fx.envelopes(spark, sf)))


@query(f"{views('ledger')} SELECT {EXPORT_SQL} FROM ledger WHERE status = 'QUARANTINED'")
def quarantine_queue(spark, sf):
    return flat(review_queue(store.export_ledger(fx.ledger(spark, sf))))


@query(f"""{views('gapped')} SELECT i.txn_id, l.binding_hash, l.status, l.txn_id IS NOT NULL AS found
    FROM (SELECT lower('TXN-' || CAST(o_orderkey AS VARCHAR)) AS txn_id FROM orders) i
    LEFT JOIN gapped l ON lower(l.txn_id) = i.txn_id""")
def ledger_lookup(spark, sf):
    """Ids in other case looked up in the ledger."""
    ids = fx.table(spark, sf, "orders").select(F.lower(F.concat(F.lit("TXN-"), F.col("o_orderkey").cast("string"))).alias("txn_id"))
    return lookup(ids, fx.gapped_ledger(spark, sf), ignore_case=True).select("txn_id", "binding_hash", "status", "found")


@query(f"""{views('verified')} SELECT txn_id, amount_cents, recomputed_hash, stored_hash, outcome,
    outcome = 'VERIFIED' AS verified FROM verified""")
def verify_ledger(spark, sf):
    """Claims against a stored ledger by recomputation."""
    held = store.read_ledger(spark, fx.stored_ledger(spark, sf), columns=["txn_id", "binding_hash"])
    return verify_claims(fx.claims(spark, sf), held, fx.KEY)


@query(f"""{views('verified')} SELECT txn_id, step, detail, status FROM (
    SELECT txn_id, 'DERIVE_R' AS step, 'nonce from key and ' || txn_id AS detail, 'DONE' AS status, outcome FROM verified
    UNION ALL SELECT txn_id, 'LOAD_MATRIX_A', 'no matrix in this binding', 'SKIPPED', outcome FROM verified
    UNION ALL SELECT txn_id, 'COMPUTE_AS_E', 'keyed hash of id and amount', 'DONE', outcome FROM verified
    UNION ALL SELECT txn_id, 'BITWISE_COMPARE', substr(stored_hash, 1, 16) || ' / ' || substr(recomputed_hash, 1, 16),
        'DONE', outcome FROM verified
    UNION ALL SELECT txn_id, 'RESULT', CASE outcome WHEN 'VERIFIED' THEN 'bindings agree' ELSE 'bindings differ' END,
        outcome, outcome FROM verified)
    WHERE outcome <> 'NOT_FOUND'""")
def verification_trace(spark, sf):
    """Five steps per claim that was found."""
    outcomes = verify_claims(fx.claims(spark, sf), fx.gapped_ledger(spark, sf), fx.KEY)
    return outcomes.select("txn_id", F.explode(trace()).alias("t")).select("txn_id", "t.*")


@query(f"""{views('verified')} SELECT txn_id, 'TXN ' || txn_id || ' not found in ledger' AS error FROM verified
    WHERE outcome = 'NOT_FOUND'""")
def verification_errors(spark, sf):
    outcomes = verify_claims(fx.claims(spark, sf), fx.gapped_ledger(spark, sf), fx.KEY)
    return outcomes.select("txn_id", error_text().alias("error")).where("error is not null")


@query(f"""{views('verified', 'open_claims')} SELECT txn_id, outcome FROM verified WHERE txn_id IN (SELECT txn_id FROM open_claims)
    UNION ALL SELECT txn_id, 'MISSING_CLAIM' FROM gapped WHERE txn_id NOT IN (SELECT txn_id FROM open_claims)""")
def reconcile_ledger(spark, sf):
    """Both directions: claims without ledger row, ledger rows without claim."""
    return reconcile(fx.open_claims(spark, sf), fx.gapped_ledger(spark, sf), fx.KEY)


@query(f"{views('verified')} SELECT txn_id, outcome FROM verified")
def verify_ledger_lattice(spark, sf):
    """The same verification with lattice commitments on both sides."""
    held = commit_table(fx.raw_txns(spark, sf).where(F.col("k") != 13), fx.KEY, "lwe", seed=fx.SEED)
    outcomes = verify_claims(fx.claims(spark, sf), held, fx.KEY, "lwe", seed=fx.SEED)
    return outcomes.select("txn_id", "outcome")


@query(f"""{views('gapped', 'actions')}, last AS (SELECT txn_id, action, resolved_by FROM actions
        WHERE action IN ('AUTHORIZE', 'TERMINATE', 'QUARANTINE')
        QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY action_seq DESC) = 1)
    SELECT l.txn_id, l.status AS status_before, a.action, a.resolved_by, CASE a.action WHEN 'AUTHORIZE' THEN 'VERIFIED'
        WHEN 'TERMINATE' THEN 'REJECTED' WHEN 'QUARANTINE' THEN 'QUARANTINED' ELSE l.status END AS status
    FROM gapped l LEFT JOIN last a USING (txn_id)""")
def resolve_reviews(spark, sf):
    """Ledger after the last valid decision on each record."""
    done = resolve(fx.gapped_ledger(spark, sf), fx.actions(spark, sf))
    return done.select("txn_id", "status_before", "action", "resolved_by", "status")


@query(f"""{views('gapped', 'actions')}
    SELECT txn_id, action, 400 AS code, 'Unknown action: ' || action AS detail FROM actions WHERE action = 'FREEZE'
    UNION ALL SELECT txn_id, action, 404, 'TXN ' || txn_id || ' not found' FROM actions
    WHERE action <> 'FREEZE' AND txn_id NOT IN (SELECT txn_id FROM gapped)""")
def refused_reviews(spark, sf):
    """Unknown actions and unknown transactions."""
    return resolve_errors(fx.gapped_ledger(spark, sf), fx.actions(spark, sf))


_STATS = f"""count(*) AS total, count(*) FILTER (status = 'VERIFIED') AS verified,
    count(*) FILTER (status = 'QUARANTINED') AS quarantined, count(*) FILTER (status = 'REJECTED') AS rejected,
    count(*) FILTER (status = 'PENDING') AS pending,
    {percent("count(*) FILTER (status = 'VERIFIED')", 'count(*)', 1)} AS chain_integrity_pct"""


@query(f"{views('ledger')} SELECT {_STATS} FROM ledger")
def ledger_stats(spark, sf):
    return status_stats(fx.ledger(spark, sf))


@query(f"{views('ledger')} SELECT txn_type, {_STATS} FROM ledger GROUP BY txn_type")
def ledger_stats_by_type(spark, sf):
    return status_stats(fx.ledger(spark, sf), ["txn_type"])


@query(f"""{views('ledger')} SELECT CAST(make_timestamp(timestamp_ns // 1000) AS DATE)::VARCHAR AS batch_id,
    count(*) AS total, count(*) FILTER (status = 'VERIFIED') AS committed,
    count(*) FILTER (status = 'QUARANTINED') AS quarantined, count(*) FILTER (status = 'REJECTED') AS rejected,
    round((max(timestamp_ns) - min(timestamp_ns)) / 1e6, 3) AS processing_time_ms,
    round(count(*) / greatest((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 1.0), 6) AS tps,
    {percent("count(*) FILTER (status = 'VERIFIED')", 'count(*)', 1)} AS chain_integrity_pct
    FROM ledger GROUP BY 1""")
def batch_summaries(spark, sf):
    """One summary per day of ledger rows."""
    rows = fx.ledger(spark, sf).withColumn("batch_id", date_bucket(F.col("timestamp_ns")).cast("string"))
    return batch_summary(rows).withColumns({
        "processing_time_ms": F.round("processing_time_ms", 3), "tps": F.round("tps", 6)
    })


@query(f"{views('raw')} SELECT txn_id, {mac(fx.KEY, 'txn_id')} AS nonce FROM raw")
def keyed_nonces(spark, sf):
    return fx.raw_txns(spark, sf).select("txn_id", keyed_nonce(fx.KEY, F.col("txn_id")).alias("nonce"))


@query(f"""{views('raw')} SELECT txn_id, {BINDING} AS binding_hash, base64(unhex({BINDING})) AS commitment_b64,
    sha256(account_id) AS account_hash FROM raw""")
def commit_hmac(spark, sf):
    """Native keyed commitments for the whole table."""
    made = commit_table(fx.raw_txns(spark, sf), fx.KEY)
    return made.select("txn_id", "binding_hash", "commitment_b64", "account_hash")


@query()
def commit_lattice(spark, sf):
    """Lattice commitments for the whole table."""
    made = commit_table(fx.raw_txns(spark, sf), fx.KEY, "lwe", "sha3", seed=fx.SEED)
    return made.select("txn_id", "binding_hash", "size_kb", "account_hash", "status")


@query("""
    WITH judged AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN_TYPE'
                                WHEN o_orderstatus = 'P' THEN 'MISSING_SCORE' END AS reason FROM orders)
    SELECT coalesce(reason, 'committed') AS outcome, count(*) AS n FROM judged GROUP BY 1""")
def commit_with_isolation(spark, sf):
    """Bad rows are set aside with a reason, all others are committed."""
    rows = fx.order_txns(spark, sf).withColumns({
        "txn_type": F.when(F.col("txn_type") == "INTERNAL_TRANSFER", F.lit("BARTER")).otherwise(F.col("txn_type")),
        "anomaly_score": F.when(F.col("o_orderstatus") != "P", F.lit(0.1)),
    })
    good, bad = commit_batch(rows, fx.KEY)
    both = good.select(F.lit("committed").alias("outcome")).unionByName(bad.select(F.col("reject_reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))
