"""Transaction views over the given tables.

Faults to be found (altered claims, missing ledger rows, bad envelopes) are
placed by the ``k`` attribute each event carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.cases import choose
from ..functions.once import computed_once
from ..functions.risk import LIST_NAMES, NO_LIST
from ..operators.commit import commit_table, declared_params
from ..operators.graph import nearest_lists, transfer_edges
from ..operators.privacy import pseudonymise, sign, with_valid_signature
from ..session import configure, work_dir
from ..sources.ledger import append_ledger

KEY = b"audit-demo-key"
SIGN_KEY = b"feed-demo-key"
SEED = bytes(range(32))

TYPE_OF_EVENT = {
    "view": "RTGS", "click": "NEFT", "purchase": "WIRE_TRANSFER", "signup": "TRADE_SETTLEMENT",
    "error": "INTERNAL_TRANSFER",
}
TYPE_OF_PRIORITY = {
    "1-URGENT": "RTGS", "2-HIGH": "NEFT", "3-MEDIUM": "WIRE_TRANSFER", "4-NOT SPECIFIED": "TRADE_SETTLEMENT",
    "5-LOW": "INTERNAL_TRANSFER",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def events_as_raw(events: DataFrame) -> DataFrame:
    """One raw transaction per event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        _text("TXN-", F.col("event_id")).alias("txn_id"),
        _text("ACC-", F.col("user_id")).alias("account_id"),
        _text("ACC-", F.col("user_id") + 1 + F.col("event_id") % 13).alias("counterparty_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        F.lit("INR").alias("currency"),
        choose(
            [(F.col("event_type") == event, name) for event, name in TYPE_OF_EVENT.items()], F.lit("FX_CONVERSION")
        ).alias("txn_type"),
        _ns(F.col("ts")).alias("timestamp_ns"),
        (k / F.lit(100.0)).alias("anomaly_score"),
        F.from_json("props", "map<string,string>").alias("metadata"),
        k.alias("k"),
    )


def raw_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_raw(table(spark, sf_dir, "events"))


def hashed_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(raw_txns(spark, sf_dir))


def watch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed accounts (node, tier, list_name); some are on two lists."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 50 = 7")
    tiers = F.array((F.floor(F.col("user_id") / 50) % 3 + 1).cast("int"), F.when(F.col("user_id") % 100 == 7, 3).otherwise(1))
    listed = users.select(_text("ACC-", F.col("user_id")).alias("node"), F.explode(F.array_distinct(tiers)).alias("tier"))
    return listed.withColumn("list_name", choose([(F.col("tier") == tier, name) for tier, name in LIST_NAMES.items()], F.lit(NO_LIST)))


def nearest(spark: SparkSession, sf_dir: str, max_hops: int = 5) -> DataFrame:
    """Nearest watch list of each account hash, by transfers."""
    lists = watch_lists(spark, sf_dir).withColumn("node", F.sha2("node", 256))
    return nearest_lists(transfer_edges(hashed_txns(spark, sf_dir), "account_hash", "counterparty_hash"), lists, max_hops)


def order_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order, from customer to the customer's next neighbour by key."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        _text("ORD-", F.col("o_orderkey")).alias("txn_id"),
        _text("CUST-", F.col("o_custkey")).alias("account_id"),
        _text("CUST-", F.col("o_custkey") + 1).alias("counterparty_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_cents"),
        F.lit("USD").alias("currency"),
        choose(
            [(F.col("o_orderpriority") == p, name) for p, name in TYPE_OF_PRIORITY.items()], F.lit("UNKNOWN")
        ).alias("txn_type"),
        _ns(F.col("o_orderdate")).alias("timestamp_ns"),
        F.col("o_orderstatus"),
    )


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text, the form a topic carries."""
    raw = raw_txns(spark, sf_dir)
    return raw.select(F.to_json(F.struct(*[c for c in raw.columns if c != "k"])).alias("value"))


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON text in the other spelling: transaction_id, amount, type."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.to_json(F.struct(
        _text("ORD-", F.col("o_orderkey")).alias("transaction_id"),
        _text("CUST-", F.col("o_custkey")).alias("account_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("type"),
        _ns(F.col("o_orderdate")).alias("timestamp_ns"),
    )).alias("value"))


def idless_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON text without any id of their own but the order's number in the metadata."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.to_json(F.struct(
        _text("CUST-", F.col("o_custkey")).alias("account_id"),
        _ns(F.col("o_orderdate")).alias("timestamp_ns"),
        F.create_map(F.lit("number"), F.col("o_orderkey").cast("string")).alias("metadata"),
    )).alias("value"))


def chat_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts: feed values that are no transactions."""
    return table(spark, sf_dir, "conversations").select(F.col("text").alias("value"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction, committed."""
    return commit_table(raw_txns(spark, sf_dir), KEY)


def gapped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a writer that lost the rows with k = 13, for operators that look for missing rows."""
    return commit_table(raw_txns(spark, sf_dir).where(F.col("k") != 13), KEY)


def stored_ledger(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the gapped ledger, written twice so that ids have to be resolved on read."""
    path = work_dir(spark, "ledger")
    rows = gapped_ledger(spark, sf_dir)
    append_ledger(rows.withColumn("status", F.lit("PENDING")), path, 0)
    append_ledger(rows, path, 1)
    return path


def open_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a claimant who never claims sign-ups."""
    return claims(spark, sf_dir, F.col("txn_type") != "TRADE_SETTLEMENT")


def claims(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """Claimed amounts; one cent too much where k = 7."""
    raw = raw_txns(spark, sf_dir)
    raw = raw if which is None else raw.where(which)
    amount = F.col("amount_cents") + F.when(F.col("k") == 7, F.lit(1)).otherwise(F.lit(0))
    return raw.select("txn_id", amount.alias("amount_cents"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported records with faults: upper-case hash (k=21), personal bytes (k=34), other modulus (k=55), forged
    signature (k=13)."""
    committed = computed_once(commit_table(raw_txns(spark, sf_dir), KEY, keep=("k",)), "binding_hash")
    signed = computed_once(sign(committed, SIGN_KEY), "signature")
    other = declared_params().withField("q", F.lit(7681))
    shown = signed.select(
        "txn_id", "timestamp_ns", "status",
        F.when(F.col("k") == 21, F.upper("binding_hash")).otherwise(F.col("binding_hash")).alias("binding_hash"),
        F.when(F.col("k") == 34, F.lit(8)).when(F.col("k") == 3, F.lit(None)).otherwise(F.lit(0)).alias("pii_bytes"),
        F.when(F.col("k") == 55, other).otherwise(declared_params()).alias("lwe_params"),
        F.when(F.col("k") == 13, F.reverse("signature")).otherwise(F.col("signature")).alias("signature"),
    )
    return with_valid_signature(shown, SIGN_KEY).drop("signature")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of review decisions on high scores."""
    raw = raw_txns(spark, sf_dir).where(F.col("anomaly_score") >= 0.75)
    first = choose(
        [(F.col("txn_type") == "WIRE_TRANSFER", "TERMINATE"), (F.col("txn_type") == "NEFT", "FREEZE")],
        F.lit("AUTHORIZE"),
    )
    second = raw.where(F.col("txn_type") == "RTGS").select(
        "txn_id", F.lit("QUARANTINE").alias("action"), F.lit("desk-2").alias("resolved_by"), F.lit(2).alias("action_seq")
    )
    third = raw_txns(spark, sf_dir).where(F.col("k") == 13).select(
        "txn_id", F.lit("AUTHORIZE").alias("action"), F.lit("desk-3").alias("resolved_by"), F.lit(3).alias("action_seq")
    )
    return (
        raw.select("txn_id", first.alias("action"), F.lit("desk-1").alias("resolved_by"), F.lit(1).alias("action_seq"))
        .unionByName(second).unionByName(third)
    )
