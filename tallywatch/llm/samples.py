"""Bounded training samples of labelled and unlabelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import spread_join
from .graph import saved


def fold_of(folds: int) -> Column:
    """Unsigned CRC-32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def one_text_each(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, text) of which each doc_id has one text, the least, and those with another one, if there are any.

    Rows without a doc_id, and rows that repeat with the same text, are all in the first.
    """
    mark = F.xxhash64("text")
    known = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    ids = saved(known.where("low <> high").select("doc_id"), "repeated-ids")
    if ids.isEmpty():
        return rows, None
    least = saved(rows.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("least")), "least-texts")
    placed = spread_join(rows, least, ["doc_id"], "left")
    other = F.coalesce(F.col("text") != F.col("least"), F.lit(False))
    return placed.where(~other).select("doc_id", "text"), placed.where(other).select("doc_id", "text")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, training: Column, most_per_class: int) -> DataFrame:
    """doc_id, text and label of at most ``most_per_class`` training documents of either class.

    Labels that are null or neither 0 nor 1 are left out; a document labelled
    twice takes the larger one. The ids joined to the documents are at most
    twice the bound, so they are broadcast. Of texts that share a doc_id the least counts.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & training)
    one = one.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = _first(one.where("label = 1"), most_per_class).unionByName(_first(one.where("label = 0"), most_per_class))
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def unlabelled(docs: DataFrame, training: Column, most: int) -> DataFrame:
    """doc_id and text of at most ``most`` documents, whatever their labels; of texts that share a doc_id the least."""
    ids = _first(docs.select("doc_id").where(F.col("doc_id").isNotNull() & training).distinct(), most)
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
