"""Micro-batch sinks. A sink is a function (name, frame, batch_id)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

log = logging.getLogger(__name__)

Sink = Callable[[str, DataFrame, int], None]
Hook = Callable[[DataFrame, int], None]


def parquet_sink(path: str) -> Sink:
    """One folder per name and batch; a retried batch replaces its own folder."""
    def write(name: str, frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

    return write


def kafka_sink(bootstrap: str, topics: dict[str, str]) -> Sink:
    """JSON records to the topic mapped to each name, keyed by transaction; delivery is at least once."""
    def write(name: str, frame: DataFrame, batch_id: int) -> None:
        records = frame.select(F.col("txn_id").alias("key"), F.to_json(F.struct(*frame.columns)).alias("value"))
        records.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topics[name]).save()

    return write


def run_hooks(hooks: Iterable[Hook], frame: DataFrame, batch_id: int) -> None:
    """User functions on the batch; a failing one is logged and does not stop the stream."""
    for hook in hooks:
        try:
            hook(frame, batch_id)
        except Exception:
            log.exception("hook %s failed on batch %d", getattr(hook, "__name__", hook), batch_id)
