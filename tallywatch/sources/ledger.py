"""The ledger: partitioned Parquet, append, upsert on read, paging, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timeparts import DAY_NS, date_bucket
from ..schemas import EXPORT_COLS, EXPORT_V2_COLS, LWE_PARAMS


def latest_by(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Last write wins: the row with the greatest ``order`` per key.

    An aggregate, not a window, so copies of one key collapse before the shuffle. A column
    that is in ``order`` too is taken from the greatest order, not carried twice.
    """
    ranked = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    told = {o: f"_top._o{i}" for i, o in enumerate(order) if isinstance(o, str) and o in df.columns and o not in key}
    rest = [c for c in df.columns if c not in key and c not in told]
    aggregates = [F.max(ranked).alias("_top")] if told else []
    # an aggregate is always there, so that keys alone stay distinct; max_by is needed for what no order tells
    if rest or not told:
        aggregates.append(F.max_by(F.struct(*rest) if rest else F.lit(1), ranked).alias("_row"))
    found = {**{c: F.col(place) for c, place in told.items()}, **{c: F.col(f"_row.{c}") for c in rest}}
    return df.groupBy(*key).agg(*aggregates).select(*[found.get(c, F.col(c)).alias(c) for c in df.columns])


def append_ledger(ledger: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append by day. With a batch id the write replaces that batch's part of its days, so a retry is harmless.

    Days come first in the folders, so that readers list the days they need. The
    rebalance hint merges small days and splits a day that holds much of the data.
    """
    dated = ledger.withColumn("date_bucket", date_bucket(F.col("timestamp_ns")))
    if batch_id is None:
        dated.hint("rebalance", "date_bucket").write.mode("append").partitionBy("date_bucket").parquet(path)
        return
    numbered = dated.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    writer = numbered.hint("rebalance", "date_bucket").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("date_bucket", "batch_id").parquet(path)


def read_ledger(spark: SparkSession, path: str, dedup: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Ledger rows; with ``dedup`` the last batch wins per transaction.

    Only ``columns``, and those that decide which row is last, are read. An id
    belongs to one day, so a filter on ``date_bucket`` reaches the scan.
    """
    ledger = spark.read.option("basePath", path).parquet(path)
    if columns is not None and not dedup:
        return ledger.select(*columns)
    if not dedup:
        return ledger
    order = [c for c in ("batch_id", "timestamp_ns", "binding_hash") if c in ledger.columns]
    key = [c for c in ("txn_id", "date_bucket") if c in ledger.columns]
    wanted = columns or ledger.columns
    return latest_by(ledger.select(*dict.fromkeys([*key, *order, *wanted])), key, order).select(*wanted)


def compact_ledger(spark: SparkSession, path: str, target: str) -> None:
    """The resolved ledger as a table of its own: one row for each id, few files for each day."""
    read_ledger(spark, path).drop("batch_id").hint("rebalance", "date_bucket").write.mode("errorifexists").partitionBy(
        "date_bucket").parquet(target)


def page_after(ledger: DataFrame, cursor: tuple[int, str], limit: int = 500) -> DataFrame:
    """The next ``limit`` rows after a (timestamp_ns, txn_id) cursor, oldest first.

    The pair is a total order, so rows sharing the boundary time are not lost;
    every day from the cursor's on is read, so midnight loses nothing either.
    """
    ns, txn_id = cursor
    rows = ledger
    if "date_bucket" in ledger.columns:
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(ns // DAY_NS).cast("int"))
        rows = rows.where(F.col("date_bucket") >= day)
    after = (F.col("timestamp_ns") > ns) | ((F.col("timestamp_ns") == ns) & (F.col("txn_id") > txn_id))
    return rows.where(F.col("timestamp_ns") >= ns).where(after).orderBy("timestamp_ns", "txn_id").limit(limit)


def next_cursor(page: DataFrame, cursor: tuple[int, str]) -> tuple[int, str]:
    """Cursor after a page; unchanged when the page is empty."""
    top = page.agg(F.max(F.struct("timestamp_ns", "txn_id")).alias("top")).first()["top"]
    return cursor if top is None else (top["timestamp_ns"], top["txn_id"])


def tag_stage(rows: DataFrame, stage: str = "CASSANDRA_POLLED") -> DataFrame:
    """Add the stage name; parse ``lwe_params`` when it is JSON text (null counts as {})."""
    out = rows.withColumn("pipeline_stage", F.lit(stage))
    if dict(out.dtypes).get("lwe_params") == "string":
        text = F.coalesce("lwe_params", F.lit("{}"))
        out = out.withColumn("lwe_params", F.from_json(text, LWE_PARAMS))
    return out


def export_ledger(ledger: DataFrame) -> DataFrame:
    """All records without payload, listed columns only."""
    return ledger.select(*[F.lit(0).alias(c) if c == "pii_bytes" else F.col(c) for c in EXPORT_COLS])


def export_ledger_v2(records: DataFrame) -> DataFrame:
    """The wider record: both parties' hashes, binding and signature."""
    have = records.withColumns({
        c: F.lit(None).cast("string") for c in ("commitment_binding", "signature_b64") if c not in records.columns
    })
    return have.select(*[F.lit(0).alias(c) if c == "pii_bytes" else F.col(c) for c in EXPORT_V2_COLS])


def write_export(ledger: DataFrame, path: str, fmt: str = "json") -> None:
    """The export as files, JSON lines or any other Spark format."""
    export_ledger(ledger).write.mode("errorifexists").format(fmt).save(path)


def write_vault(ledger: DataFrame, path: str) -> None:
    """Append-only Parquet archive by day."""
    append_ledger(ledger, path)


