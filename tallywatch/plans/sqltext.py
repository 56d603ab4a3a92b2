"""SQL views that mirror the transaction views, for checking results in DuckDB."""

from __future__ import annotations

import math

from ..functions.digits import EXPECTED_PCT
from ..functions.hashing import mac_pads
from ..functions.normal import CDF_B, CDF_P
from ..functions.risk import FAR, LIST_NAMES, NO_LIST
from .fixtures import KEY, TYPE_OF_EVENT, TYPE_OF_PRIORITY


def case(column: str, values: dict[str, object], default: str) -> str:
    arms = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {arms} ELSE '{default}' END"


def mac(key: bytes, message: str) -> str:
    inner, outer = (pad.hex() for pad in mac_pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def digit_of(amount: str) -> str:
    return f"TRY_CAST(nullif(substr(CAST(abs({amount}) AS VARCHAR), 1, 1), '0') AS INTEGER)"


def percent(part: str, whole: str, digits: int) -> str:
    scale = 10 ** digits
    return (
        f"CASE WHEN {whole} > 0 THEN CAST(({part} * {200 * scale} + {whole}) // ({whole} * 2) AS DOUBLE) / {scale}"
        f" ELSE 0.0 END"
    )


def benford_gap(amount: str) -> str:
    arms = " ".join(
        f"WHEN {digit_of(amount)} = {d} THEN abs(log10(1 + 1.0 / {d}) - {round(p / 100, 3)}) / {round(p / 100, 3)}"
        for d, p in enumerate(EXPECTED_PCT, start=1)
    )
    return f"CASE WHEN {amount} <= 0 THEN 0.5 {arms} END"


def cdf(z: str) -> str:
    t = f"(CAST(1 AS DOUBLE) / (1 + {CDF_P} * abs({z})))"
    poly = "0"
    for b in reversed(CDF_B):
        poly = f"{t} * (({b}) + {poly})"
    tail = f"{poly} * exp(-0.5 * ({z}) * ({z})) * {1 / math.sqrt(2 * math.pi)!r}"
    return f"CASE WHEN {z} >= 0 THEN 1 - ({tail}) ELSE {tail} END"


HOUR = "(timestamp_ns // 3600000000000 % 24)"
WEEKDAY = "((timestamp_ns // 86400000000000 + 3) % 7)"
OFFHOURS = f"({HOUR} < 6 OR {HOUR} > 22)"
WEEKEND = f"({WEEKDAY} >= 5)"
STATUS = "CASE WHEN anomaly_score >= 0.75 THEN 'QUARANTINED' ELSE 'VERIFIED' END"
PARAMS_JSON = '{"n":256,"k":2,"q":3329,"eta":2}'
BINDING = mac(KEY, "txn_id || '|' || CAST(amount_cents AS VARCHAR)")

VIEWS = {
    "raw": f"""
        SELECT 'TXN-' || CAST(event_id AS VARCHAR) AS txn_id, 'ACC-' || CAST(user_id AS VARCHAR) AS account_id,
               'ACC-' || CAST(user_id + 1 + event_id % 13 AS VARCHAR) AS counterparty_id,
               CAST(round(value * 100) AS BIGINT) AS amount_cents, 'INR' AS currency,
               {case('event_type', TYPE_OF_EVENT, 'FX_CONVERSION')} AS txn_type,
               epoch_us(ts) * 1000 AS timestamp_ns,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS anomaly_score
        FROM events""",
    "hashed": "SELECT *, sha256(account_id) AS account_hash, sha256(counterparty_id) AS counterparty_hash FROM raw",
    "order_txns": f"""
        SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS txn_id, 'CUST-' || CAST(o_custkey AS VARCHAR) AS account_id,
               'CUST-' || CAST(o_custkey + 1 AS VARCHAR) AS counterparty_id,
               CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, 'USD' AS currency,
               {case('o_orderpriority', TYPE_OF_PRIORITY, 'UNKNOWN')} AS txn_type,
               epoch_us(o_orderdate) * 1000 AS timestamp_ns, o_orderstatus
        FROM orders""",
    "ledger": f"""
        SELECT txn_id, {BINDING} AS binding_hash, 0.03125::DOUBLE AS size_kb, '{PARAMS_JSON}' AS lwe_params,
               timestamp_ns, 0 AS pii_bytes, sha256(account_id) AS account_hash, txn_type, {STATUS} AS status,
               anomaly_score
        FROM raw""",
    "gapped": "SELECT * FROM ledger WHERE txn_id IN (SELECT txn_id FROM raw WHERE k <> 13)",
    "claims": "SELECT txn_id, amount_cents + CASE WHEN k = 7 THEN 1 ELSE 0 END AS amount_cents FROM raw",
    "open_claims": "SELECT * FROM claims WHERE txn_id IN (SELECT txn_id FROM raw WHERE txn_type <> 'TRADE_SETTLEMENT')",
    "verified": f"""
        SELECT c.txn_id, c.amount_cents, c.recomputed_hash, l.binding_hash AS stored_hash,
               CASE WHEN l.binding_hash IS NULL THEN 'NOT_FOUND'
                    WHEN l.binding_hash = c.recomputed_hash THEN 'VERIFIED' ELSE 'FAILED' END AS outcome
        FROM (SELECT *, {BINDING} AS recomputed_hash FROM claims) c LEFT JOIN gapped l USING (txn_id)""",
    "envelopes": f"""
        SELECT txn_id, timestamp_ns, {STATUS} AS status,
               CASE WHEN k = 21 THEN upper({BINDING}) ELSE {BINDING} END AS binding_hash,
               CASE WHEN k = 34 THEN 8 WHEN k = 3 THEN NULL ELSE 0 END AS pii_bytes,
               CASE WHEN k = 55 THEN 7681 ELSE 3329 END AS q, k NOT IN (13, 21) AS signature_valid
        FROM raw""",
    "actions": """
        SELECT txn_id, CASE txn_type WHEN 'WIRE_TRANSFER' THEN 'TERMINATE' WHEN 'NEFT' THEN 'FREEZE'
                       ELSE 'AUTHORIZE' END AS action, 'desk-1' AS resolved_by, 1 AS action_seq
        FROM raw WHERE anomaly_score >= 0.75
        UNION ALL SELECT txn_id, 'QUARANTINE', 'desk-2', 2 FROM raw WHERE anomaly_score >= 0.75 AND txn_type = 'RTGS'
        UNION ALL SELECT txn_id, 'AUTHORIZE', 'desk-3', 3 FROM raw WHERE k = 13""",
    "checks": """
        SELECT txn_id, timestamp_ns, status AS ledger_status, 'SIGNATURE' AS "check",
               CASE WHEN signature_valid THEN 'PASS' ELSE 'FAIL' END AS status,
               CASE WHEN signature_valid THEN 'signature matches' ELSE 'signature does not match' END AS detail FROM envelopes
        UNION ALL
        SELECT txn_id, timestamp_ns, status, 'PII_ASSERTION', CASE WHEN coalesce(pii_bytes, 0) = 0 THEN 'PASS' ELSE 'FAIL' END,
               CAST(coalesce(pii_bytes, 0) AS VARCHAR) || ' personal bytes declared' FROM envelopes
        UNION ALL
        SELECT txn_id, timestamp_ns, status, 'BINDING_HASH_FORMAT',
               CASE WHEN regexp_full_match(binding_hash, '[0-9a-f]{64}') THEN 'PASS' ELSE 'FAIL' END,
               CAST(length(binding_hash) AS VARCHAR) || ' of 64 hex characters' FROM envelopes
        UNION ALL
        SELECT txn_id, timestamp_ns, status, 'LWE_PARAMS', CASE WHEN q = 3329 THEN 'PASS' ELSE 'FAIL' END,
               '{"n":256,"k":2,"q":' || CAST(q AS VARCHAR) || ',"eta":2}' FROM envelopes""",
    "counted": """
        SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY timestamp_ns
                                 RANGE BETWEEN 3599999999999 PRECEDING AND CURRENT ROW) AS velocity
        FROM hashed""",
    "lists": f"""
        SELECT user_id, 'ACC-' || CAST(user_id AS VARCHAR) AS account_id, sha256('ACC-' || CAST(user_id AS VARCHAR)) AS node, tier,
               CASE tier {' '.join(f"WHEN {tier} THEN '{name}'" for tier, name in LIST_NAMES.items())} END AS list_name
        FROM (SELECT DISTINCT user_id, unnest([user_id // 50 % 3 + 1, CASE WHEN user_id % 100 = 7 THEN 3 ELSE 1 END]) AS tier
              FROM events WHERE user_id % 50 = 7)""",
    "transfers": "SELECT DISTINCT account_hash AS src, counterparty_hash AS dst FROM hashed WHERE account_hash <> counterparty_hash",
    "label_walk": """
        SELECT node, 0 AS hops, tier, list_name FROM lists UNION
        SELECT t.src, w.hops + 1, w.tier, w.list_name FROM label_walk w JOIN transfers t ON t.dst = w.node WHERE w.hops < 5""",
    "nearest": """
        SELECT node, hops, tier, list_name FROM (
            SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, tier, list_name) AS nth FROM label_walk) WHERE nth = 1""",
    "next_hop": """
        SELECT d.node, min(n.node) AS next FROM nearest d JOIN transfers t ON t.src = d.node
        JOIN nearest n ON n.node = t.dst AND n.hops = d.hops - 1 AND n.tier = d.tier AND n.list_name = d.list_name GROUP BY d.node""",
    "way": """
        SELECT node, node AS stop, 0 AS seq FROM nearest UNION ALL
        SELECT w.node, h.next, w.seq + 1 FROM way w JOIN next_hop h ON h.node = w.stop""",
    "near": f"""
        SELECT * EXCLUDE (nth) FROM (
            SELECT c.*, coalesce(n.hops, {FAR}) AS hops, coalesce(n.list_name, '{NO_LIST}') AS list_name, n.node AS party,
                   row_number() OVER (PARTITION BY c.txn_id ORDER BY n.hops NULLS LAST, n.tier, n.list_name, p.paths) AS nth
            FROM counted c LEFT JOIN nearest n ON n.node IN (c.account_hash, c.counterparty_hash)
            LEFT JOIN (SELECT node, string_agg(stop, ',' ORDER BY seq) AS paths FROM way GROUP BY node) p ON p.node = n.node) WHERE nth = 1""",
    "features": f"""
        SELECT *, CASE WHEN amount_cents > 0 THEN ln(1 + amount_cents) ELSE 0 END AS log_amount,
               {HOUR} / 23.0 AS hour_of_day, {WEEKDAY} / 6.0 AS day_of_week,
               CASE txn_type WHEN 'NEFT' THEN 1 WHEN 'WIRE_TRANSFER' THEN 2 WHEN 'TRADE_SETTLEMENT' THEN 3
                             WHEN 'INTERNAL_TRANSFER' THEN 4 WHEN 'FX_CONVERSION' THEN 5 ELSE 0 END / 5.0 AS txn_type_enc,
               {benford_gap('amount_cents')} AS benford_deviation, least(velocity / 100.0, 1.0) AS velocity_1h,
               least(hops / 8.0, 1.0) AS graph_hops, CAST({OFFHOURS} AS INTEGER)::DOUBLE AS is_offhours,
               CAST({WEEKEND} AS INTEGER)::DOUBLE AS is_weekend
        FROM near""",
    "scored": """
        SELECT *, CASE WHEN score > 0.85 AND hops <= 2 THEN list_name
                       WHEN score > 0.75 THEN 'HIGH_ANOMALY_SCORE'
                       WHEN benford_deviation > 0.7 THEN 'BENFORD_VIOLATION' ELSE 'NONE' END AS flag_reason,
               score * (1 - 0.05 * benford_deviation) AS reconstruction_loss,
               CASE WHEN score >= 0.32 THEN 'QUARANTINED' ELSE 'VERIFIED' END AS status
        FROM (SELECT *, greatest(0.0, least(1.0, 0.25 * benford_deviation + 0.30 * greatest(0.0, 1.0 - graph_hops)
                     + 0.20 * velocity_1h + 0.15 * is_offhours
                     + 0.10 * least(greatest(0.0, (log_amount - 20.0) / 5.0), 1.0))) AS score
              FROM features)""",
    "stats": """
        SELECT count(*) AS n, avg(anomaly_score) AS mu, greatest(stddev_samp(anomaly_score), 0.001) AS sigma FROM ledger""",
}

_NEEDS = {
    "raw": [], "hashed": ["raw"], "order_txns": [], "ledger": ["raw"], "claims": ["raw"],
    "verified": ["claims", "gapped"], "gapped": ["ledger"], "open_claims": ["claims"], "envelopes": ["raw"], "actions": ["raw"], "checks": ["envelopes"],
    "counted": ["hashed"], "lists": [], "transfers": ["hashed"],
    "label_walk": ["lists", "transfers"], "nearest": ["label_walk"], "next_hop": ["nearest", "transfers"], "way": ["next_hop"],
    "near": ["counted", "way"], "features": ["near"], "scored": ["features"],
    "stats": ["ledger"],
}


def views(*names: str) -> str:
    """WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    body = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH RECURSIVE {body}"
