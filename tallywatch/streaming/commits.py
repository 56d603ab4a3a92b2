"""Raw feed to ledger, committed and anomaly outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commit import commit_problem, commit_table
from ..operators.privacy import with_valid_signature
from ..operators.status import ingest_counts
from ..schemas import DEFAULT_THRESHOLD
from ..sources.ledger import append_ledger, export_ledger
from ..sources.raw import normalise_lenient, parse_raw, split_rejects
from .sinks import Hook, Sink, parquet_sink, run_hooks


def ingest_message() -> Column:
    """Text a producer signs."""
    return F.concat_ws("|", "txn_id", "account_id", F.col("amount_cents").cast("string"))


def judge(feed: DataFrame, sign_key: bytes | None = None, normalise: Callable = normalise_lenient) -> DataFrame:
    """Parse and normalise a feed; every row carries its reject reason or null."""
    rows = normalise(parse_raw(feed))
    if sign_key is None:
        return rows
    checked = with_valid_signature(rows, sign_key, ingest_message())
    reason = F.when(~F.col("signature_valid"), F.lit("BAD_SIGNATURE"))
    return checked.withColumn("reject_reason", F.coalesce("reject_reason", reason)).drop("signature_valid")


def fan_out(records: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> dict[str, DataFrame]:
    """All records go to "committed"; those at or above the threshold also to "anomalies"."""
    return {"committed": records, "anomalies": records.where(F.col("anomaly_score") >= threshold)}


def commit_stream(
    feed: DataFrame,
    out: str,
    key: bytes,
    checkpoint: str,
    sign_key: bytes | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    normalise: Callable = normalise_lenient,
    sink: Sink | None = None,
    on_committed: Sequence[Hook] = (),
    on_anomaly: Sequence[Hook] = (),
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run the feed into ``out``/ledger and the sinks; rejects and counters go beside the ledger.

    Every output of a batch is replaced as a whole when the batch is retried.
    Repeated ids are kept; the ledger resolves them on read, last batch first.
    """
    write = sink or parquet_sink(out)

    def run(batch: DataFrame, batch_id: int) -> None:
        judged = judge(batch, sign_key, normalise).persist()
        try:
            # a row that cannot be committed is set aside like one that cannot be read
            sound = judged.withColumn("reject_reason", F.coalesce("reject_reason", commit_problem()))
            good, bad = split_rejects(sound)
            ledger = commit_table(good, key, threshold=threshold, **options).persist()
            try:
                append_ledger(ledger, f"{out}/ledger", batch_id)
                outputs = fan_out(export_ledger(ledger), threshold)
                for name, frame in outputs.items():
                    write(name, frame, batch_id)
                parquet_sink(out)("rejects", bad, batch_id)
                parquet_sink(out)("counters", ingest_counts(sound), batch_id)
                run_hooks(on_committed, outputs["committed"], batch_id)
                run_hooks(on_anomaly, outputs["anomalies"], batch_id)
            finally:
                ledger.unpersist()
        finally:
            judged.unpersist()

    writer = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
