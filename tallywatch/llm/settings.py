"""Session settings the corpus operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ship_package

#: Arrow batches of whole texts; several workers of an executor hold one each.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Give Python workers the package, bound the Arrow batches they receive by bytes, and let shuffle files go with their job.

    Work between steps lies in tables, so no later job reads the shuffle files of an earlier one.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
