"""Hop distance to blacklisted nodes over the transfer graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from ..session import remove_dir, shared_dir, work_dir


def transfer_edges(
    txns: DataFrame, src: str = "account_id", dst: str = "counterparty_id", both_ways: bool = False
) -> DataFrame:
    """Distinct transfers (src, dst), without transfers to oneself.

    ``both_ways`` counts a transfer as a link in either direction: pairs are
    made distinct without regard to direction, then each is given twice.
    """
    pairs = txns.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src") != F.col("dst"))
    if not both_ways:
        return pairs.distinct()
    links = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    sides = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return links.select(F.explode(sides).alias("e")).select("e.*")


def _hubs(edges: DataFrame, per_part: int) -> DataFrame:
    """Nodes with more than ``per_part`` edges into them, and the parts their edges are cut into."""
    degree = edges.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > per_part)
    return degree.select("dst", F.ceil(F.col("n") / per_part).cast("bigint").alias("parts"))


def _bucketed_by_target(edges: DataFrame, hubs: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Edges as a table bucketed by (dst, part), so that no hop shuffles them again; only hubs have several parts."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1).cast("bigint"))).alias("part")
    cut = edges.join(hubs, "dst", "left").select("src", "dst", part)
    writer = cut.repartition(buckets, "dst", "part").write.bucketBy(buckets, "dst", "part")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return spark.table(name)


def _spread(frontier: DataFrame, hubs: DataFrame, *more: str) -> DataFrame:
    """The frontier once for each part of a node's edges."""
    last = F.coalesce("parts", F.lit(1).cast("bigint")) - 1
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    return frontier.join(hubs, frontier["node"] == hubs["dst"], "left").select(F.col("node").alias("dst"), parts.alias("part"), *more)


def _met(incoming: DataFrame, frontier: DataFrame, hubs: DataFrame, *more: str) -> DataFrame:
    """Edges into the frontier. The frontier's part of a bucket is hashed, at most its nodes, and edges stream past unsorted."""
    spread = _spread(frontier, hubs, *more).hint("shuffle_hash")
    return incoming.join(spread, ["dst", "part"], "inner" if more else "left_semi")


@contextmanager
def _incoming(edges: DataFrame, per_part: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Edges bucketed by their target, and hubs, while a search lasts; the table lies in the shared folder."""
    spark = edges.sparkSession
    shared_dir(spark)
    name, path, plain = "edges_" + uuid.uuid4().hex, work_dir(spark, "edges"), work_dir(spark, "pairs")
    try:
        edges.select("src", "dst").write.parquet(f"{plain}/edges")
        edges = spark.read.schema(edges.select("src", "dst").schema).parquet(f"{plain}/edges")
        # files have a size, so the join to a few hubs needs no shuffle of the edges
        hubs = _hubs(edges, per_part)
        hubs.write.parquet(f"{plain}/hubs")
        hubs = spark.read.schema(hubs.schema).parquet(f"{plain}/hubs")
        yield _bucketed_by_target(edges, hubs, name, path), hubs
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_dir(spark, path)
        remove_dir(spark, plain)


def hops_to_blacklist(edges: DataFrame, blacklist: DataFrame, max_hops: int = 5, per_part: int = 1_000_000) -> DataFrame:
    """Least number of transfers from each node to a blacklisted one, up to ``max_hops``.

    ``edges`` comes from :func:`transfer_edges`, ``blacklist`` has (node). A breadth-first search
    against the edge direction. The edges are written once, bucketed by the
    node they end in; each hop hashes the frontier and streams them past it, so
    that no hop shuffles or sorts them, keeps each new node once, and is checkpointed in the shared folder. Edges into a hub are cut by
    their source into as many parts as its degree asks for, ``per_part`` edges
    each, and only hubs are repeated in the frontier. The table of edges is
    dropped with its files when the search ends.
    """
    with _incoming(edges, per_part) as (incoming, hubs):
        frontier = blacklist.select("node").distinct().withColumn("hops", F.lit(0)).checkpoint()
        reached = frontier
        for hop in range(1, max_hops + 1):
            found = _met(incoming, frontier, hubs).select(F.col("src").alias("node")).distinct()
            new = found.join(reached.select("node"), "node", "left_anti")
            frontier = new.withColumn("hops", F.lit(hop)).checkpoint()
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        return reached


def nearest_lists(edges: DataFrame, lists: DataFrame, max_hops: int = 5, per_part: int = 1_000_000) -> DataFrame:
    """The nearest watch list of each node that reaches one by at most ``max_hops`` transfers.

    ``edges`` comes from :func:`transfer_edges`, ``lists`` is a table of listed
    nodes (node, tier, list_name); a node may be on several lists. Result: node,
    hops (0 for a listed node), tier, list_name, path (all nodes from this one to
    the listed one). The fewest hops count, then the lowest tier, then the name;
    among equal paths the one whose next node is smallest, step by step.

    A breadth-first search from all listed nodes at once: a node keeps the least
    label of the frontier it transfers to, since a nearest list of its own is one
    hop nearer to some neighbour. Edges, hubs and checkpoints as in
    :func:`hops_to_blacklist`. Null nodes are left out; without lists or edges
    the result holds the listed nodes alone.
    """
    label = F.min(F.struct("tier", "list_name")).alias("best")
    start = lists.where(F.col("node").isNotNull()).groupBy("node").agg(label)
    columns = ["node", F.col("best.tier").alias("tier"), F.col("best.list_name").alias("list_name")]
    with _incoming(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), per_part) as (incoming, hubs):
        frontier = start.select(*columns, F.array("node").alias("path")).withColumn("hops", F.lit(0)).checkpoint()
        reached = frontier
        for hop in range(1, max_hops + 1):
            met = _met(incoming, frontier, hubs, "tier", "list_name", "path")
            met = met.select(F.col("src").alias("node"), F.struct("tier", "list_name", F.col("dst").alias("next"), "path").alias("way"))
            new = met.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min("way").alias("best"))
            path = F.concat(F.array("node"), "best.path").alias("path")
            frontier = new.select(*columns, path).withColumn("hops", F.lit(hop)).checkpoint()
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        return reached.select("node", "hops", "tier", "list_name", "path")
