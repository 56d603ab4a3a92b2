"""Envelope checks on exported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import computed_once
from ..schemas import LWE_ETA, LWE_K, LWE_N, LWE_Q


# Names of the checks.
SIGNATURE, PII, BINDING, PARAMS = "SIGNATURE", "PII_ASSERTION", "BINDING_HASH_FORMAT", "LWE_PARAMS"


def _check(name: str, ok: Column, detail: Column) -> Column:
    status = F.when(F.coalesce(ok, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL"))
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))


def _signature_check(valid: Column | None) -> Column:
    """PASS or FAIL by the verified signature; without one nothing is claimed."""
    if valid is None:
        status, detail = F.lit("NOT_CHECKED"), F.lit("no signature given")
    else:
        status = F.when(valid, F.lit("PASS")).when(~valid, F.lit("FAIL")).otherwise(F.lit("NOT_CHECKED"))
        detail = F.when(valid, F.lit("signature matches")).when(~valid, F.lit("signature does not match")).otherwise(
            F.lit("no signature given"))
    return F.struct(F.lit(SIGNATURE).alias("check"), status.alias("status"), detail.alias("detail"))


def check_list(binding: Column, pii_bytes: Column, params: Column, signature_valid: Column | None = None) -> Column:
    """The four checks as an array of (check, status, detail)."""
    pii = F.coalesce(pii_bytes, F.lit(0))
    digest = F.coalesce(binding, F.lit(""))
    expected = (params["n"] == LWE_N) & (params["k"] == LWE_K) & (params["q"] == LWE_Q) & (params["eta"] == LWE_ETA)
    return F.array(
        _signature_check(signature_valid),
        _check(PII, pii == 0, F.concat(pii.cast("string"), F.lit(" personal bytes declared"))),
        _check(BINDING, digest.rlike("^[0-9a-f]{64}$"), F.concat(F.length(digest).cast("string"), F.lit(" of 64 hex characters"))),
        _check(PARAMS, expected, F.coalesce(F.to_json(params), F.lit("none"))),
    )


def check_envelopes(df: DataFrame) -> DataFrame:
    """Add ``checks`` and ``overall``; the binding may be named ``commitment``.

    A verified ``signature_valid`` column decides the signature check. Overall is
    FAIL if any check fails, PASS if all pass, and INCOMPLETE if one was not made.
    """
    for costly in ("binding_hash", "signature_valid"):
        df = computed_once(df, costly) if costly in df.columns else df
    names = [c for c in ("binding_hash", "commitment") if c in df.columns]
    binding = F.coalesce(*names) if names else F.lit("")
    valid = F.col("signature_valid") if "signature_valid" in df.columns else None
    checked = df.withColumn("checks", check_list(binding, F.col("pii_bytes"), F.col("lwe_params"), valid))
    failed = F.exists("checks", lambda c: c["status"] == "FAIL")
    passed = F.forall("checks", lambda c: c["status"] == "PASS")
    return checked.withColumn(
        "overall", F.when(failed, F.lit("FAIL")).when(passed, F.lit("PASS")).otherwise(F.lit("INCOMPLETE"))
    )


def check_counts(checked: DataFrame) -> DataFrame:
    """Passes and failures per check."""
    return (
        checked.select(F.explode("checks").alias("c"))
        .groupBy(F.col("c.check").alias("check"), F.col("c.status").alias("status"))
        .agg(F.count("*").alias("n"))
    )
