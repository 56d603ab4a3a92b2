"""How near transactions are to a watch list, and by which transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import spread_join
from ..functions.risk import FAR, NO_LIST


def with_proximity(hashed: DataFrame, near: DataFrame, paths: bool = True) -> DataFrame:
    """Rows with hops, list_name and path of the nearer of their two parties.

    ``near`` comes from :func:`graph.nearest_lists` over account hashes. Fewer
    hops count, then the lower tier, then the name, then the lesser hash. Without
    a list in reach hops are ``FAR``, the name is NONE and the path is empty.
    Paths are wide: without ``paths`` the rows name the nearer party in ``nearer``
    instead, and :func:`with_paths` adds them where they are wanted.
    """
    rows = hashed
    for party in ("account", "counterparty"):
        found = F.struct("hops", "tier", "list_name").alias(f"_{party}_near")
        rows = spread_join(rows, near.select(F.col("node").alias(f"{party}_hash"), found), [f"{party}_hash"], "left")
    labels = [
        F.when(F.col(f"_{party}_near").isNotNull(),
               F.struct(F.col(f"_{party}_near").alias("label"), F.col(f"{party}_hash").alias("node")))
        for party in ("account", "counterparty")
    ]
    rows = rows.withColumn("_near", F.array_min(F.array(*labels))).drop("_account_near", "_counterparty_near")
    rows = rows.withColumns({
        "hops": F.coalesce("_near.label.hops", F.lit(FAR)), "list_name": F.coalesce("_near.label.list_name", F.lit(NO_LIST)),
        "nearer": F.col("_near.node"),
    }).drop("_near")
    return with_paths(rows, near).drop("nearer") if paths else rows


def with_paths(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Add ``path``, all nodes from the party named in ``nearer`` to its nearest listed one; empty where there is none."""
    ways = near.select(F.col("node").alias("nearer"), F.xxhash64("node").alias("_mark"), F.col("path"))
    # rows without a list in reach are dealt out by their whole, not into one task
    mark = F.when(F.col("nearer").isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64("nearer"))
    found = rows.withColumn("_mark", mark).join(ways, ["nearer", "_mark"], "left").drop("_mark")
    return found.select(*rows.columns, F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def proximity_edges(scored: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Transfers from the nearer party of each row to the listed one, one row each, from (txn_id, path, list_name).

    Every edge is a transfer of the graph; none is left out. The last one carries
    the number of hops and the list. A listed party needs no transfer and gives no row.
    Given ``near``, the paths are looked up there for rows of (txn_id, nearer, hops, list_name).
    """
    if near is not None:
        moving = scored.where(F.col("nearer").isNotNull() & (F.col("hops") > 0))
        scored = with_paths(moving.select("txn_id", "nearer", "list_name"), near)
    count = F.size("path") - 1
    steps = scored.where(count > 0).select(
        "txn_id", "path", "list_name", count.alias("_count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    last = F.col("seq") == F.col("_count") - 1
    hop_text = F.concat(F.col("_count").cast("string"), F.when(F.col("_count") > 1, F.lit(" HOPS")).otherwise(F.lit(" HOP")))
    return steps.select(
        "txn_id", "seq", F.get("path", F.col("seq")).alias("src"), F.get("path", F.col("seq") + 1).alias("dst"),
        F.when(last, hop_text).otherwise(F.lit("TRANSFERS_TO")).alias("label"),
        F.when(last, F.col("list_name")).otherwise(F.get("path", F.col("seq") + 1)).alias("dst_label"),
    )
