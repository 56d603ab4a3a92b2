"""Health of stream stages, from the progress their queries report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ratios import percent

# States of a stage and of the whole, and the limits that part them.
ONLINE, WARNING, NOMINAL, DEGRADED = "ONLINE", "WARNING", "NOMINAL", "DEGRADED"
MOST_ERRORS, MOST_BATCH_MS, MOST_LOAD = 10, 500, 80

_PROGRESS = "stage string, batch_id bigint, input_rows bigint, batch_ms bigint, interval_ms bigint, processed bigint, errors bigint"


def progress_rows(spark: SparkSession, stages: dict[str, StreamingQuery], trigger_ms: int | None = None) -> DataFrame:
    """One row for each batch a query still remembers (100 unless set otherwise), whatever the stream's size.

    ``processed`` and ``errors`` are the observed counters of that name, null
    without :func:`operators.status.observe_ingest`; ``interval_ms`` is the time
    a batch may take, null where the query has no interval.
    """
    rows = []
    for stage, query in stages.items():
        for p in query.recentProgress:
            seen = [r.asDict() for r in (p.observedMetrics or {}).values()]
            total = lambda name: sum(r[name] for r in seen if name in r) if any(name in r for r in seen) else None
            failed = [total("errors"), total("signature_failures")]
            errors = None if failed == [None, None] else sum(f or 0 for f in failed)
            rows.append((stage, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), trigger_ms, total("processed"), errors))
    return spark.createDataFrame(rows, _PROGRESS)


def stage_health(
    progress: DataFrame, most_errors: int = MOST_ERRORS, most_batch_ms: int = MOST_BATCH_MS, most_load: int = MOST_LOAD
) -> DataFrame:
    """stage, batches, total, errors, slowest_ms, load_pct and status, one row a stage.

    A stage warns with ``most_errors`` errors or more, a batch of ``most_batch_ms``
    or longer, or a load (time in batches over the time they may take) above
    ``most_load`` percent. What is not measured does not warn.
    """
    sums = progress.groupBy("stage").agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("input_rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.max("batch_ms").alias("slowest_ms"),
        percent(F.sum(F.when(F.col("interval_ms").isNotNull(), F.col("batch_ms"))), F.sum("interval_ms"), 1).alias("load_pct"),
    )
    quiet = (F.col("errors") < most_errors) & F.coalesce(F.col("slowest_ms") < most_batch_ms, F.lit(True))
    quiet = quiet & F.coalesce(F.col("load_pct") <= most_load, F.lit(True))
    return sums.withColumn("status", F.when(quiet, F.lit(ONLINE)).otherwise(F.lit(WARNING)))


def overall(health: DataFrame) -> DataFrame:
    """One row: NOMINAL if there are stages and all are online, else DEGRADED."""
    fine = F.coalesce(F.bool_and(F.col("status") == ONLINE), F.lit(False))
    return health.agg(F.when(fine, F.lit(NOMINAL)).otherwise(F.lit(DEGRADED)).alias("overall"))
