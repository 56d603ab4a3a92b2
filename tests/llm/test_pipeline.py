"""The pipeline stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from .helpers import components, frame, messy, prose, without_repeats

SF = "/root/testdata/sf0.01"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "packing"]


def test_model_stages_drop_what_they_reject(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, good in (("toxicity", F.col("toxic") == 0), ("quality classifier", F.col("quality") == 1)):
        kept = STAGE[name](spark, docs, SF).cache()
        assert kept.columns == docs.columns and kept.count() < docs.count()
        judged = kept.join(labels, "doc_id")
        assert judged.where(~good).count() <= 0.2 * labels.where(~good).count()
        assert judged.where(good).count() >= 0.95 * labels.where(good).count()


def test_near_duplicates_leave_the_smallest_of_each_group(spark):
    docs = frame(spark, messy())
    kept = STAGE["n-gram Jaccard join"](spark, docs, SF)
    want = components(messy(), 5, 80)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(d) for d, (_, c) in want.items() if c == d] + ["None"])
    assert STAGE["n-gram Jaccard join"](spark, frame(spark, []), SF).count() == 0


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, prose(1, 30)), (1, prose(1, 30)), (2, prose(2, 30)), (None, "a"), (None, "a")])
    kept = [r.doc_id for r in STAGE["n-gram Jaccard join"](spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == ["1", "2", "None", "None"]


def test_passages_are_cut_and_columns_stay(spark):
    rows = [(d, t) for d, t in messy() if d != 40]
    docs = frame(spark, rows)
    out = STAGE["suffix-array dedup"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    for doc, (size, removed, _, _) in without_repeats(rows, 100).items():
        text = got[doc].text or ""
        assert len(text.encode()) <= size - removed and (removed or text == (dict(rows)[doc] or ""))
        if removed:
            assert got[doc].n_chars == len(text)
    assert STAGE["suffix-array dedup"](spark, frame(spark, []), SF).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark):
    """Of near duplicates the least text stays; of passages the least text is cut, the other row stays whole."""
    shared, other = prose("shared", 40), prose("other", 40)
    rows = [(1, shared), (2, shared + " tail"), (2, other), (3, other + " end"), (3, other + " end")]
    for _ in range(2):
        kept = {(r.doc_id, r.text) for r in STAGE["suffix-array dedup"](spark, frame(spark, rows), SF).collect()}
        least, more = sorted([shared + " tail", other])
        cut = {t: next(r for d, r in kept if d == 2 and r != more) for t in (least,)}
        assert (2, more) in kept and (1, shared) in kept and len(kept) == 4
        assert len(cut[least]) < len(least) if least.startswith(shared) else cut[least] == least
    near = STAGE["n-gram Jaccard join"](spark, frame(spark, [(5, "z " + other), (5, "a " + shared), (9, prose("nine", 30))]), SF)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == [(5, "a " + shared), (9, prose("nine", 30))]


def test_run_packs_what_is_left(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = pieces.select("doc_id").distinct().count()
    assert 100 < docs < 200
    longest = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert longest <= 1024
