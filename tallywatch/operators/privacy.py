"""Pseudonyms, redaction, PII checks and the signature gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_id, hmac_sha256
from ..schemas import FORBIDDEN_COLS


def pseudonymise(df: DataFrame, alg: str = "sha2") -> DataFrame:
    """Add ``account_hash`` and ``counterparty_hash``; the ids stay until :func:`redact`."""
    return df.withColumns({
        "account_hash": hash_id(F.col("account_id"), alg),
        "counterparty_hash": hash_id(F.col("counterparty_id"), alg),
    })


def redact(df: DataFrame) -> DataFrame:
    """Drop raw ids, amounts and free-form metadata."""
    return df.drop(*FORBIDDEN_COLS, "metadata")


def pii_free() -> Column:
    """True when the record declares no personal bytes; a missing value counts as 0."""
    return F.coalesce(F.col("pii_bytes"), F.lit(0)) == 0


def split_pii(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(pii_free()), df.where(~pii_free())


def signed_text() -> Column:
    return F.concat_ws("|", "txn_id", "binding_hash")


def sign(df: DataFrame, key: bytes, message: Column | None = None) -> DataFrame:
    """Add ``signature``: a MAC over the message, by default id and binding hash."""
    return df.withColumn("signature", hmac_sha256(key, signed_text() if message is None else message))


def with_valid_signature(df: DataFrame, key: bytes, message: Column | None = None) -> DataFrame:
    expected = hmac_sha256(key, signed_text() if message is None else message)
    return df.withColumn("signature_valid", F.coalesce(F.col("signature") == expected, F.lit(False)))


def split_signed(df: DataFrame, key: bytes, message: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose signature verifies, and all others."""
    checked = with_valid_signature(df, key, message)
    good = checked.where("signature_valid").drop("signature_valid")
    return good, checked.where(~F.col("signature_valid")).drop("signature_valid")


def forbidden_columns(export: DataFrame) -> list[str]:
    """Names in an export's schema that must not be there."""
    return sorted(c for c in export.columns if c.lower() in FORBIDDEN_COLS or c.lower().startswith("amount"))


def _texts(export: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """All columns of a record as (column, text); nested ones as JSON, so that what they hold is seen too."""
    nested = ("struct", "array", "map")
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            (F.to_json(f.name) if f.dataType.typeName() in nested else F.col(f.name).cast("string")).alias("text"),
        )
        for f in export.schema.fields if f.name not in skip
    ]
    return F.explode(F.array(*cells))


def leaked_ids(export: DataFrame, raw: DataFrame, token: str = "[A-Za-z0-9_-]+") -> DataFrame:
    """Raw identifiers that stand anywhere in an export, in text or nested values, with their counts per column.

    Texts are cut into tokens; a token that is an id counts, so ACC-1 is not
    found in ACC-12. Tokens and ids meet in one aggregate over the value, which
    collapses a value that stands in every row before the shuffle.
    """
    cells = export.select(_texts(export).alias("c")).select("c.*")
    tokens = cells.select("column", F.explode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("value"))
    ids = raw.select(F.explode(F.array("account_id", "counterparty_id")).alias("value")).where("value <> ''")
    met = tokens.unionByName(ids.select(F.lit(None).cast("string").alias("column"), "value"))
    names = [f.name for f in export.schema.fields]
    counts = [F.count_if(F.col("column") == name).alias(f"_n{i}") for i, name in enumerate(names)]
    found = met.groupBy("value").agg(F.bool_or(F.col("column").isNull()).alias("_id"), *counts).where("_id")
    sums = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"_n{i}").alias("n")) for i, name in enumerate(names)])
    return found.select("value", F.explode(sums).alias("c")).select("c.column", "value", "c.n").where("n > 0")


def leaked_amounts(export: DataFrame, raw: DataFrame) -> DataFrame:
    """Transactions whose own amount appears as a whole number anywhere in an exported value, text or nested.

    The semi join on id and number never pairs up copies of an id.
    """
    cells = export.select("txn_id", _texts(export, ("txn_id",)).alias("c")).select("txn_id", "c.*")
    number = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![0-9A-Za-z])-?[0-9]+(?![0-9A-Za-z])"), F.lit(0))))
    numbers = cells.select("txn_id", "column", number.alias("value"))
    own = raw.select("txn_id", F.col("amount_cents").cast("string").alias("value"))
    return numbers.join(own, ["txn_id", "value"], "left_semi").select("txn_id", "column")
