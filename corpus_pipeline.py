"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywatch.llm import quality, toxicity
from tallywatch.llm.graph import saved, tidy
from tallywatch.llm.jaccard import jaccard_components
from tallywatch.llm.marks import marked, marks_of
from tallywatch.llm.packing import pack
from tallywatch.llm.repeats import remove_repeats
from tallywatch.llm.settings import ready

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Labels cannot be learned in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic.

    Each row is judged by its own whole text: null and empty texts by the bias
    alone, repeated rows and rows without a doc_id like any other, whatever
    other columns there are. Without labels, or of one class only, nothing is
    called toxic unless labelled texts mostly are. An empty table stays empty.
    """
    tidy(ready(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.train(docs, labels, training=~toxicity.held_out()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier calls good.

    Each row is judged by its own whole text, null and empty texts like a text
    without words; repeated rows, rows without a doc_id and extra columns do not
    matter. An empty table stays empty.
    """
    tidy(ready(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels, training=~quality.held_out()))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 5-word shingles at similarity 0.8.

    Of rows that repeat a doc_id the one with the least text stays; rows without a
    doc_id all stay. Null and empty texts have no copies. Only rows that may have
    to go are shuffled.
    """
    tidy(ready(spark))
    linked = saved(jaccard_components(docs, words=5, percent=80).where("doc_id is not null"), "near")
    copies = linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times"))
    doubtful = saved(copies.where("doc_id <> component_id or times > 1"), "near")
    field = marks_of(doubtful.select("doc_id"))
    gone = doubtful.where("doc_id <> component_id").select("doc_id")
    twice = doubtful.where("doc_id = component_id").select("doc_id")
    maybe = marked(docs, field, True)
    once = maybe.join(gone, "doc_id", "left_anti").join(twice, "doc_id", "left_anti").select(*docs.columns)
    place, whole = _free_name("place", docs.columns), F.xxhash64(*docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", whole))
    one = maybe.join(twice, "doc_id", "left_semi").withColumn(place, nth).where(F.col(place) == 1).select(*docs.columns)
    return marked(docs, field, False).unionByName(once).unionByName(one)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that occurred earlier in the corpus.

    A character of which only some bytes are left goes with the rest. n_chars,
    where there is such a column, becomes the length of what is left. Of texts that
    share a doc_id the least takes part; rows with another one, and rows without a
    doc_id, stay whole. Null and empty texts stay as they are. Documents that lose
    nothing are not shuffled.
    """
    tidy(ready(spark))
    left = remove_repeats(docs).where("n_removed > 0").select("doc_id", "mark", "kept").dropDuplicates(["doc_id", "mark"])

    def readable(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [k.decode(errors="ignore") for k in part.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(texts, pa.string())], ["doc_id", "mark", "rest"])

    changed = saved(left.mapInArrow(readable, "doc_id bigint, mark bigint, rest string"), "passages")
    field = marks_of(changed.select("doc_id").distinct())
    name, mark = _free_name("rest", docs.columns), _free_name("mark", docs.columns)
    changed = changed.withColumnsRenamed({"rest": name, "mark": mark})
    hashed = marked(docs, field, True).withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = hashed.join(changed, ["doc_id", mark], "left")
    new = {"text": F.coalesce(F.col(name), F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length(name).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(name).isNotNull(), length).otherwise(F.col("n_chars"))
    shorter = joined.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
    return marked(docs, field, False).unionByName(shorter)


def _free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    Null and empty texts are their end id alone, very long ones are cut, repeated
    rows and rows without a doc_id are packed each. An empty table gives no row.
    """
    tidy(ready(spark))
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("suffix-array dedup", remove_passages),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
