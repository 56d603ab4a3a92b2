"""Record layouts and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Transaction types in code order, review states, currencies.
TXN_TYPES = ["RTGS", "NEFT", "WIRE_TRANSFER", "TRADE_SETTLEMENT", "INTERNAL_TRANSFER", "FX_CONVERSION"]
STATUSES = ["PENDING", "VERIFIED", "QUARANTINED", "REJECTED", "PROCESSING"]
CURRENCIES = ["INR", "USD", "EUR", "GBP", "JPY", "AED", "SGD"]

# Parameters of the lattice commitment.
LWE_N, LWE_K, LWE_Q, LWE_ETA = 256, 2, 3329, 2

DEFAULT_THRESHOLD = 0.75

METADATA = T.MapType(T.StringType(), T.StringType())

# Wire form: both spellings a producer may use; values arrive as JSON text.
RAW_JSON = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("counterparty_id", T.StringType()),
    T.StructField("amount_cents", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("timestamp_ns", T.StringType()),
    T.StructField("anomaly_score", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("metadata", METADATA),
])

LWE_PARAMS = T.StructType([
    T.StructField("n", T.IntegerType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("q", T.IntegerType()),
    T.StructField("eta", T.IntegerType()),
])

LEDGER_COLS = [
    "txn_id", "commitment_b64", "binding_hash", "size_kb", "lwe_params", "timestamp_ns",
    "pii_bytes", "account_hash", "txn_type", "status", "anomaly_score",
]
EXPORT_COLS = [c for c in LEDGER_COLS if c != "commitment_b64"]
EXPORT_V2_COLS = [
    "txn_id", "account_hash", "counterparty_hash", "currency", "txn_type", "timestamp_ns",
    "status", "anomaly_score", "commitment_binding", "signature_b64", "pii_bytes",
]

# Columns that must never appear in an export.
FORBIDDEN_COLS = ["account_id", "counterparty_id", "amount", "amount_cents"]
