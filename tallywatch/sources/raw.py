"""Raw transaction feeds: read, parse, normalise, split off bad records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import METADATA, RAW_JSON

_CORRUPT = "_corrupt"
_PARSE_SCHEMA = T.StructType(RAW_JSON.fields + [T.StructField(_CORRUPT, T.StringType())])

RAW_TOPIC, COMMITTED_TOPIC, ANOMALY_TOPIC = "transactions.raw", "transactions.committed", "transactions.anomalies"

WIRE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def kafka_stream(spark: SparkSession, bootstrap: str, topics: list[str], **options: str) -> DataFrame:
    """Topics from their earliest offset as (topic, value); needs the Kafka package on the cluster.

    Pass ``startingTimestamp`` (ms) to resume from a point in time instead.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
    )
    return reader.options(**options).load().select("topic", F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files of a folder as a stream, one file per trigger unless told otherwise."""
    return spark.readStream.format(fmt).schema(schema).options(**{"maxFilesPerTrigger": "1", **options}).load(path)


def parse_raw(feed: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to raw columns; ``malformed`` marks text that is no JSON object.

    The text is parsed below a one-element explode: later filters on the parsed
    fields are not pushed through it, which would parse each text once per use.
    """
    parsed = F.from_json(
        F.col(value), _PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    keep = [c for c in feed.columns if c != value]
    out = feed.select(*keep, F.col(value), F.explode(F.array(parsed)).alias("_p"))
    malformed = F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull() | ~F.ltrim(F.col(value)).startswith("{")
    return out.select(
        *keep,
        F.col(value).alias("raw_value"),
        *[F.col(f"_p.{f.name}").alias(f.name) for f in RAW_JSON.fields],
        F.coalesce(malformed, F.lit(True)).alias("malformed"),
    )


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _whole(text: Column, factor: int = 1) -> Column:
    """Decimal text times ``factor``, truncated; exact, null when not a number or out of range."""
    return F.try_multiply(text.try_cast("decimal(32,6)"), F.lit(factor)).try_cast("bigint")


def _reject_reason(amount_text: Column) -> Column:
    def bad(text: Column, value: Column) -> Column:
        return text.isNotNull() & value.isNull()

    return (
        F.when(F.col("malformed"), F.lit("MALFORMED_JSON"))
        .when(bad(amount_text, F.col("amount_cents")), F.lit("BAD_AMOUNT"))
        .when(bad(F.col("_score_text"), F.col("anomaly_score")), F.lit("BAD_SCORE"))
        .when(bad(F.col("_ts_text"), F.col("timestamp_ns")), F.lit("BAD_TIMESTAMP"))
    )


def record_id(df: DataFrame) -> Column:
    """Id of a record that brings none: a hash of its whole text and, where the feed tells it, its place there.

    A replay gives the same id; different texts never share one.
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("topic", "partition", "offset") if c in df.columns]
    return F.sha2(F.concat_ws("\x1f", F.coalesce("raw_value", F.lit("")), *place), 256)


def _now_ns() -> Column:
    return F.unix_micros(F.current_timestamp()) * F.lit(1000)


def _finish(df: DataFrame, columns: dict[str, Column], amount_text: Column, amount: Column, default_amount: Column,
            default_ns: Column) -> DataFrame:
    keep = [c for c in df.columns if c not in set(RAW_JSON.fieldNames()) | {"raw_value", "malformed"}]
    typed = df.select(
        *keep, "raw_value", "malformed", "signature",
        *[expr.alias(name) for name, expr in columns.items()],
        amount_text.alias("_amount_text"),
        amount.alias("amount_cents"),
        F.col("timestamp_ns").alias("_ts_text"),
        _whole(F.col("timestamp_ns")).alias("timestamp_ns"),
        F.col("anomaly_score").alias("_score_text"),
        F.col("anomaly_score").try_cast("double").alias("anomaly_score"),
    )
    reasoned = typed.withColumn("reject_reason", _reject_reason(F.col("_amount_text")))
    return reasoned.select(
        *keep, *columns, F.coalesce("amount_cents", default_amount).alias("amount_cents"),
        F.coalesce("timestamp_ns", default_ns).alias("timestamp_ns"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        "signature", "raw_value", "reject_reason",
    )


def normalise_lenient(parsed: DataFrame, default_ns: Column | None = None) -> DataFrame:
    """Accept either spelling of a field, fill gaps, and note why a row must be rejected.

    ``amount`` is in currency units; it is scaled as a decimal, so 19.99 is 1999 cents.
    """
    cents = F.col("amount_cents")
    amount = F.when(cents.isNotNull(), _whole(cents)).otherwise(_whole(F.col("amount"), 100))
    columns = {
        "txn_id": F.coalesce(_filled("txn_id"), _filled("transaction_id"), record_id(parsed)),
        "account_id": F.coalesce("account_id", F.lit("unknown")),
        "counterparty_id": F.coalesce("counterparty_id", F.lit("")),
        "currency": F.coalesce("currency", F.lit("INR")),
        "txn_type": F.coalesce("txn_type", "type", F.lit("UNKNOWN")),
        "metadata": F.coalesce("metadata", F.create_map().cast(METADATA)),
    }
    return _finish(parsed, columns, F.coalesce(cents, F.col("amount")), amount, F.lit(0).cast("bigint"),
                   default_ns if default_ns is not None else _now_ns())


def normalise_strict(parsed: DataFrame, default_ns: Column | None = None) -> DataFrame:
    """Model defaults. A missing id is derived from the record, see :func:`record_id`."""
    columns = {
        "txn_id": F.coalesce(_filled("txn_id"), record_id(parsed)),
        "account_id": F.coalesce("account_id", F.lit("")),
        "counterparty_id": F.coalesce("counterparty_id", F.lit("")),
        "currency": F.coalesce("currency", F.lit("INR")),
        "txn_type": F.coalesce("txn_type", F.lit("RTGS")),
        "metadata": F.coalesce("metadata", F.create_map().cast(METADATA)),
    }
    return _finish(parsed, columns, F.col("amount_cents"), _whole(F.col("amount_cents")), F.lit(0).cast("bigint"),
                   default_ns if default_ns is not None else _now_ns())


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejected rows with their raw text and reason."""
    keys = [c for c in ("topic", "txn_id", "raw_value", "reject_reason") if c in df.columns]
    good = df.where(F.col("reject_reason").isNull()).drop("reject_reason", "raw_value")
    return good, df.where(F.col("reject_reason").isNotNull()).select(*keys)


def union_topics(frames: dict[str, DataFrame]) -> DataFrame:
    """Several feeds as one, each row tagged with its topic."""
    out = None
    for topic, frame in frames.items():
        tagged = frame.withColumn("topic", F.lit(topic))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def route(df: DataFrame, topics: list[str]) -> dict[str, DataFrame]:
    """One frame per topic."""
    return {topic: df.where(F.col("topic") == topic).drop("topic") for topic in topics}
