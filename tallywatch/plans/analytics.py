"""Aggregates, rates, feeds and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digits import EXPECTED_PCT, hash_digit, leading_digit
from ..functions.normal import normal_cdf
from ..functions.risk import flag_reason, model_score
from ..operators import benford, distribution, feeds, status, throughput
from ..operators.envelope import check_envelopes
from ..operators.proximity import with_proximity
from ..sources.raw import union_topics
from ..streaming.commits import fan_out
from . import fixtures as fx
from .registry import query
from .sqltext import cdf, digit_of, percent, views


def cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


@query(f"""{views('ledger')} SELECT CAST(regexp_extract(binding_hash, '[1-9]') AS INTEGER) AS digit, count(*) AS n
    FROM ledger WHERE regexp_extract(binding_hash, '[1-9]') <> '' GROUP BY 1""")
def hash_digit_counts(spark, sf):
    """Leading digits of binding hashes."""
    return benford.digit_counts(fx.ledger(spark, sf), hash_digit(F.col("binding_hash")))


_LINE_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"""SELECT digit, count(*) AS n FROM (SELECT {digit_of(_LINE_CENTS)} AS digit FROM lineitem)
    WHERE digit IS NOT NULL GROUP BY digit""")
def amount_digit_counts(spark, sf):
    """Leading digits of line amounts."""
    return benford.digit_counts(fx.table(spark, sf, "lineitem"), leading_digit(cents("l_extendedprice")))


def benford_sql(source: str, digit: str, by: str | None = None, table: bool = True) -> str:
    """Digit table or summary over ``source`` in SQL."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    counts = ", ".join(f"count(*) FILTER (d = {i}) AS c{i}" for i in range(1, 10))
    chi = " + ".join(
        f"power(({percent(f'c{i}', 'sample_count', 2)}) - {p}, 2) / {p}" for i, p in enumerate(EXPECTED_PCT, start=1)
    )
    by_count = " + ".join(
        f"power(c{i} - sample_count * {p / 100!r}, 2) / (sample_count * {p / 100!r})" for i, p in enumerate(EXPECTED_PCT, start=1)
    )
    stats = f"""SELECT *, {chi} AS chi, {by_count} AS chi2_counts
        FROM (SELECT {key}count(d) AS sample_count, {counts} FROM (SELECT {key}{digit} AS d FROM {source}) {group})"""
    tail = "sample_count, round(chi, 3) AS chi2_statistic, chi > 15.5 AS deviation_flag, round(chi2_counts, 4) AS chi2_counts"
    if not table:
        return f"SELECT {key}{tail} FROM ({stats})"
    return " UNION ALL ".join(
        f"""SELECT {key}{i} AS digit, {p}::DOUBLE AS expected_pct, {percent(f'c{i}', 'sample_count', 2)} AS observed_pct,
        c{i} AS n, {tail} FROM ({stats})""" for i, p in enumerate(EXPECTED_PCT, start=1)
    )


def _shown(df):
    return df.withColumn("chi2_counts", F.round("chi2_counts", 4))


@query(benford_sql("lineitem", digit_of(_LINE_CENTS)))
def benford_line_amounts(spark, sf):
    """Expected and observed digits of line amounts."""
    return _shown(benford.benford_table(fx.table(spark, sf, "lineitem"), leading_digit(cents("l_extendedprice"))))


@query(views("ledger") + " " + benford_sql(
    "ledger", "TRY_CAST(nullif(regexp_extract(binding_hash, '[1-9]'), '') AS INTEGER)", table=False))
def benford_binding_hashes(spark, sf):
    """The same test on hash digits, which are uniform, so it always flags."""
    return _shown(benford.benford_summary(fx.ledger(spark, sf), hash_digit(F.col("binding_hash"))))


@query(benford_sql("lineitem", digit_of(_LINE_CENTS), "l_suppkey", table=False))
def benford_by_supplier(spark, sf):
    """One test per supplier."""
    lines = fx.table(spark, sf, "lineitem")
    return _shown(benford.benford_summary(lines, leading_digit(cents("l_extendedprice")), ["l_suppkey"]))


@query(views("raw") + " " + benford_sql("raw", digit_of("amount_cents"), "txn_type"))
def benford_by_type(spark, sf):
    """Digit tables per transaction type."""
    return _shown(benford.benford_table(fx.raw_txns(spark, sf), leading_digit(F.col("amount_cents")), ["txn_type"]))


_PEAK = "1 / (sigma * sqrt(2 * pi()))"


@query(f"""{views('stats')} SELECT n, round(mu, 9) AS mu, round(sigma, 9) AS sigma, round({_PEAK}, 9) AS peak FROM stats""")
def score_distribution(spark, sf):
    stats = distribution.score_stats(fx.ledger(spark, sf))
    return stats.select("n", *[F.round(c, 9).alias(c) for c in ("mu", "sigma", "peak")])


@query(f"""{views('stats')}, span AS (SELECT *, greatest(0.0, mu - 4 * sigma) AS low, least(1.0, mu + 4 * sigma) AS high,
                                      unnest(range(200)) AS i FROM stats)
    SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(exp(-0.5 * power((x - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())), 6) AS y
    FROM (SELECT *, low + (high - low) * i / 199.0 AS x FROM span)""")
def density_curve(spark, sf):
    """200 points of the fitted density."""
    curve = distribution.density_curve(fx.ledger(spark, sf))
    return curve.select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PCT = f"round(({cdf('z')}) * 100, 2)"


@query(f"""{views('stats')} SELECT txn_id, anomaly_score, {_PCT} AS percentile, round(density, 6) AS density,
    CAST(round(CAST({_PCT} AS DECIMAL(5, 2)), 1) AS VARCHAR) || 'th' AS label
    FROM (SELECT txn_id, anomaly_score, (anomaly_score - mu) / sigma AS z,
                 greatest(exp(-0.5 * power((anomaly_score - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())), 1e-9) AS density
          FROM ledger, stats)""")
def outlier_percentiles(spark, sf):
    """Place of every score in the fitted distribution."""
    placed = distribution.outlier_percentiles(fx.ledger(spark, sf).select("txn_id", "anomaly_score"))
    return placed.select(
        "txn_id", "anomaly_score", "percentile", F.round("density", 6).alias("density"),
        distribution.percentile_label(F.col("percentile")).alias("label"),
    )


@query(f"{views('raw')} SELECT txn_id, round({cdf('(anomaly_score * 6 - 3)')}, 9) AS phi FROM raw")
def normal_cdf_values(spark, sf):
    """The distribution function between -3 and 3."""
    z = F.col("anomaly_score") * 6 - 3
    return fx.raw_txns(spark, sf).select("txn_id", F.round(normal_cdf(z), 9).alias("phi"))


@query(f"{views('raw')} SELECT txn_id, round(greatest(0.0, least(1.0, 0.5 - (0.7 - 1.4 * anomaly_score))), 9) AS score FROM raw")
def model_score_values(spark, sf):
    """Raw model outputs brought to 0..1."""
    raw = F.lit(0.7) - 1.4 * F.col("anomaly_score")
    return fx.raw_txns(spark, sf).select("txn_id", F.round(model_score(raw), 9).alias("score"))


@query("""SELECT round_even(size_kb * 2, 0) / 2 AS bucket_kb, count(*) AS n
    FROM (SELECT strlen(html) / 1024.0 AS size_kb FROM pages UNION ALL SELECT n_chars / 1024.0 FROM documents)
    WHERE size_kb > 0 GROUP BY 1""")
def payload_size_histogram(spark, sf):
    """Half-kilobyte buckets of page and document sizes."""
    return distribution.size_histogram(payload_sizes(spark, sf))


def payload_sizes(spark, sf):
    pages = fx.table(spark, sf, "pages").select((F.octet_length("html") / F.lit(1024.0)).alias("size_kb"))
    return pages.unionByName(fx.table(spark, sf, "documents").select((F.col("n_chars") / F.lit(1024.0)).alias("size_kb")))


@query("""SELECT count(*) AS total_records, round(avg(size_kb), 2) AS avg_kb
    FROM (SELECT strlen(html) / 1024.0 AS size_kb FROM pages UNION ALL SELECT n_chars / 1024.0 FROM documents)
    WHERE size_kb > 0""")
def payload_size_summary(spark, sf):
    return distribution.size_summary(payload_sizes(spark, sf))


_ELAPSED = "greatest((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 1.0)"


@query(f"""{views('ledger')} SELECT count(*) AS total, round(count(*) / {_ELAPSED}, 9) AS tps,
    round(count(*) / {_ELAPSED} / 1000, 9) AS write_rate_k FROM ledger""")
def lifetime_rate(spark, sf):
    rate = throughput.lifetime_rate(fx.ledger(spark, sf))
    return rate.select("total", F.round("tps", 9).alias("tps"), F.round("write_rate_k", 9).alias("write_rate_k"))


@query(f"""{views('raw')} SELECT window_end_s, count(*) AS n, round(count(*) / 30.0, 6) AS tps
    FROM (SELECT timestamp_ns // 1000000000 + 1 + unnest(range(30)) AS window_end_s FROM raw) GROUP BY 1""")
def sliding_tps(spark, sf):
    """Events per second over the last 30 seconds, every second."""
    return throughput.sliding_rate(fx.raw_txns(spark, sf)).withColumn("tps", F.round("tps", 6))


_HISTORY = """buckets AS (SELECT timestamp_ns // 3600000000000 AS b, count(*) AS n FROM raw GROUP BY 1),
    history AS (SELECT bar, coalesce(n, 0) / 3600.0 AS tps
                FROM (SELECT unnest(range(30)) AS bar, max(b) AS last FROM buckets) LEFT JOIN buckets ON b = last - 29 + bar)"""


@query(f"{views('raw')}, {_HISTORY} SELECT CAST(bar AS INTEGER) AS bar, '-' || CAST(30 - bar AS VARCHAR) || 's' AS label, round(tps, 9) AS tps FROM history")
def tps_history(spark, sf):
    """The last thirty hourly samples, gaps as zero."""
    return throughput.rate_history(fx.raw_txns(spark, sf), 30, 3600).withColumn("tps", F.round("tps", 9))


@query(f"""{views('raw')}, {_HISTORY.replace('3600.0', '1.0')}
    SELECT round(max(tps), 1) AS peak, round(avg(tps), 1) AS avg FROM history""")
def tps_history_summary(spark, sf):
    """Peak and mean events per hour over the last thirty hours."""
    history = throughput.rate_history(fx.raw_txns(spark, sf), 30, 3600)
    return throughput.rate_summary(history.withColumn("tps", F.round(F.col("tps") * 3600, 6)))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, round(avg(d), 6) AS avg_delay, max(d) AS max_delay,
    quantile_disc(d, 0.5) AS p50_delay, quantile_disc(d, 0.95) AS p95_delay
    FROM (SELECT o_orderdate, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000 AS d
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def ingest_delay(spark, sf):
    """Delay from order to shipment per month."""
    orders, lines = fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem")
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    delays = throughput.ingest_delay(
        both, F.unix_seconds(F.col("o_orderdate").cast("timestamp")),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")), F.date_format("o_orderdate", "yyyy-MM"),
    )
    return delays.withColumn("avg_delay", F.round("avg_delay", 6))


@query("""SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n, max((epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000) AS max_delay,
    TRUE AS p50_in_bound, TRUE AS p95_in_bound FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def delay_sketches(spark, sf):
    """Delay quantiles per year from sketches per month, and whether their exact ranks keep the bound."""
    orders, lines = fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem")
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    ordered, shipped = (F.unix_seconds(F.col(c).cast("timestamp")) for c in ("o_orderdate", "l_shipdate"))
    months = throughput.delay_sketches(both, ordered, shipped, F.date_format("o_orderdate", "yyyy-MM"))
    years = throughput.with_quantiles(throughput.merged_sketches(months, F.substring("period", 1, 4)), p50=0.5, p95=0.95)
    rows = both.select(F.date_format("o_orderdate", "yyyy").alias("period"), (shipped - ordered).alias("delay"))
    ranks = rows.join(years.select("period", "n", "max_delay", "p50", "p95"), "period").groupBy("period", "n", "max_delay").agg(*[
        F.avg((F.col("delay") < F.col(q)).cast("int") if below else (F.col("delay") <= F.col(q)).cast("int")).alias(f"{q}_{side}")
        for q in ("p50", "p95") for side, below in (("low", True), ("high", False))])
    kept = lambda q, share: (
        (F.col(f"{q}_low") <= share + throughput.RANK_ERROR) & (F.col(f"{q}_high") >= share - throughput.RANK_ERROR)).alias(f"{q}_in_bound")
    return ranks.select("period", "n", "max_delay", kept("p50", 0.5), kept("p95", 0.95))


_TOPICS = """feed AS (SELECT 'committed' AS topic, * FROM ledger
                      UNION ALL SELECT 'anomalies', * FROM ledger WHERE anomaly_score >= 0.75)"""


@query(f"""{views('ledger')}, {_TOPICS} SELECT topic, txn_id, timestamp_ns, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY timestamp_ns DESC, txn_id DESC) AS rank FROM feed)
    WHERE rank <= 500""")
def last_500_per_topic(spark, sf):
    """Snapshot of the newest records of each topic."""
    feed = union_topics(fan_out(fx.ledger(spark, sf)))
    return feeds.last_per_topic(feed, ["committed", "anomalies"], 500).select("topic", "txn_id", "timestamp_ns", "rank")


@query(f"""{views('ledger')} SELECT txn_id, timestamp_ns, status FROM ledger ORDER BY timestamp_ns DESC, txn_id DESC LIMIT 50""")
def recent_committed(spark, sf):
    return feeds.newest(fx.ledger(spark, sf), 50).select("txn_id", "timestamp_ns", "status")


@query(f"""{views('ledger')} SELECT txn_id, timestamp_ns, status FROM ledger WHERE status = 'QUARANTINED'
    ORDER BY timestamp_ns, txn_id LIMIT 20""")
def first_anomalies(spark, sf):
    """The first rows instead of the newest."""
    held = fx.ledger(spark, sf).where(F.col("status") == "QUARANTINED")
    return feeds.oldest(held, 20).select("txn_id", "timestamp_ns", "status")


@query(f"""{views('near')} SELECT txn_id, CASE WHEN anomaly_score >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
    CASE WHEN anomaly_score > 0.85 AND hops <= 2 THEN list_name WHEN anomaly_score > 0.75 THEN 'HIGH_ANOMALY_SCORE'
         ELSE 'NONE' END || ': ' || right(txn_id, 12) AS message, timestamp_ns, anomaly_score
    FROM near WHERE anomaly_score >= 0.75 ORDER BY timestamp_ns DESC, txn_id DESC LIMIT 10""")
def alert_feed(spark, sf):
    """The ten newest anomalies by severity."""
    newest = feeds.newest(fx.hashed_txns(spark, sf).where(F.col("anomaly_score") >= 0.75), 10)
    placed = with_proximity(newest, fx.nearest(spark, sf), paths=False)
    flag = flag_reason(F.col("anomaly_score"), F.col("hops"), F.col("list_name"), F.lit(0.0))
    return feeds.alert_feed(placed.withColumn("flag_reason", flag), 10)


@query(f"""{views('ledger', 'checks')} SELECT (SELECT round(count(*) / {_ELAPSED}, 9) FROM ledger) AS tps,
    (SELECT count(*) FROM ledger) AS total_commitments, (SELECT count(*) FROM ledger WHERE status = 'VERIFIED') AS verified,
    (SELECT count(*) FROM ledger WHERE status = 'QUARANTINED') AS quarantined, 0::BIGINT AS rejected,
    (SELECT {percent("count(*) FILTER (status = 'VERIFIED')", 'count(*)', 1)} FROM ledger) AS chain_integrity_pct,
    (SELECT count(*) FROM envelopes WHERE signature_valid) AS signature_verified,
    (SELECT count(*) FROM envelopes WHERE NOT signature_valid) AS signature_failed,
    (SELECT count(*) FROM checks WHERE "check" = 'PII_ASSERTION' AND status = 'FAIL') AS pii_failed""")
def audit_overview(spark, sf):
    """Ledger totals, rate and check outcomes in one row."""
    row = status.overview(fx.ledger(spark, sf), check_envelopes(fx.envelopes(spark, sf)))
    return row.withColumn("tps", F.round("tps", 9))
