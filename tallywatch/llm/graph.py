"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.joins import spread_join
from ..session import work_dir


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: later steps start from files, not from its plan."""
    path = work_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.folder = path
    return table


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage between steps, as Spark itself does every half hour.

    Plans of finished steps would fill the driver's heap up to its limit before
    they go, and only a collection lets Spark's cleaner remove their broadcasts.
    """
    spark._jvm.java.lang.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete the files of saved tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it can reach, for every node of the links (a, b).

    Large star: each node sends its larger neighbours to its smallest one. Small
    star: each node sends its smaller neighbours to its smallest one. Rounds
    repeat until nothing changes, a logarithmic number in practice. A hub's
    minimum is combined before the shuffle and its join can be split.
    """
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _size(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, ["u"], "inner")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, saved(small.where("u <> v").distinct(), "edges")
        release(old)
        tidy(edges.sparkSession)
        now = _size(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
