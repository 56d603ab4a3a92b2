"""Queries of the corpus operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import quality, toxicity
from ..session import work_dir
from .collocations import collocations
from .conversations import summaries
from .dropout import round_trip
from .fertility import quality_rules
from .fingerprints import with_edited
from .jaccard import jaccard_components
from .packing import pack
from .repair_sql import REPAIR
from .repeats import remove_repeats
from .settings import ready
from .token_counts import count_tokens
from .token_files import read_documents, write_shards
from .winnowing import decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    SQL[name] = text


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


@register
def op2_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out()
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), training=~out)
    return toxicity.score(docs, machine).withColumn("held_out", out)


@register
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@register
def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality.held_out()
    model = quality.train(docs, table(spark, sf_dir, "labels"), training=~out)
    return quality.score(docs, model).withColumn("held_out", out)


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(table(spark, sf_dir, "documents"))


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@register
def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


@register
def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words in benchmark passages, and which items those come from."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["begin"])
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


sql("op11_winnowing", r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
    runs AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
    places AS (
        SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM d, (SELECT DISTINCT size FROM runs) WHERE len(w) >= size)),
    hits AS (SELECT doc_id, i, size, item_id FROM places JOIN runs USING (size, run)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")


@register
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with drops, blanks, cut ends, repeats and wrong roles put in, and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault, text = F.crc32(name) % 20, F.coalesce("text", F.lit(" "))
    damaged = rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return summaries(damaged, F.col("copies"))


sql("op12_structure_repair", REPAIR)


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language that hold together best."""
    return collocations(table(spark, sf_dir, "documents"))


sql("op13_collocations", r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    runs AS (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
    inside AS (
        SELECT DISTINCT lang, array_to_string(v[i:j], ' ') AS phrase, f
        FROM (SELECT lang, f, v, i, unnest(range(i + 1, least(len(v), i + len(v) - 2) + 1)) AS j
              FROM (SELECT lang, f, string_split(phrase, ' ') AS v, unnest(range(1, m)) AS i FROM c WHERE m > 2))),
    covered AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
    kept AS (SELECT c.* FROM c LEFT JOIN covered USING (lang, phrase) WHERE covered.f IS NULL OR 100 * CAST(covered.f AS HUGEINT) < 80 * CAST(c.f AS HUGEINT)),
    cuts AS (
        SELECT lang, phrase, f AS a, k, array_to_string(v[1:k], ' ') AS lp, array_to_string(v[k + 1:], ' ') AS rp
        FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS v, unnest(range(1, m)) AS k FROM kept)),
    scored AS (
        SELECT cuts.*, x.f AS l, y.f AS r, 2000000 * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
