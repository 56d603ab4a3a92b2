"""Toxicity and quality: held-out accuracy, interactions, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.llm import quality, toxicity
from tallywatch.llm.queries import QUERIES

from .helpers import frame, messy, prose

SF = "/root/testdata/sf0.1"


def measured(spark, name, label):
    scored = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id")
    return scored.where("held_out").toPandas()


@pytest.mark.parametrize("name, label, least", [("op3_toxicity", "toxic", 0.97), ("op6_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    rows = measured(spark, name, label)
    assert (rows.predicted == rows[label]).mean() >= least
    assert rows.score.between(0, 1).all()
    clean = rows[rows[label] == (0 if label == "toxic" else 1)]
    assert (clean.predicted == clean[label]).mean() >= 0.98


def test_folds_are_the_crc_of_the_id(spark):
    import zlib
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: (r.a, r.b) for r in ids.select("doc_id", toxicity.held_out().alias("a"), quality.held_out().alias("b")).collect()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 5 == 0, zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200)}


def interaction(spark):
    """A text is toxic only when the insult stands beside the group: no sum of single weights tells that."""
    rows, labels = [], []
    for n in range(400):
        insult, group = n % 2, n // 2 % 2
        rows.append((n, prose(n, 12) + (" rotten" if insult else "") + (" villagers" if group else "")))
        labels.append((n, insult & group))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pairs_are_learned(spark):
    """At the production defaults."""
    docs, labels = interaction(spark)
    machine = toxicity.train(docs, labels)
    assert np.abs(machine.factors).max() > 0.1
    got = toxicity.score(docs, machine).join(labels, "doc_id")
    assert got.where("predicted = toxic").count() >= 396


def test_margins_are_those_of_a_plain_double_loop():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    texts = [prose("m", 30), "", prose("n", 5), "rotten villagers rotten", prose("o", 3)]
    known = np.flatnonzero(rng.uniform(size=toxicity.SIZE) < 0.7).astype(np.int32)
    n = len(known)
    machine = toxicity.FactorizationMachine(-0.3, rng.normal(0, 1, n), rng.normal(0, 0.5, (n, 8)), rng.uniform(0, 1, n),
                                            rng.uniform(0, 0.2, n), 3.0, known).opened()
    found = [sorted(set(hashed) & set(known.tolist())) for hashed in (toxicity.terms(pa.array([t]))[0].tolist() for t in texts)]
    places, bounds = machine.features(*toxicity.terms(pa.array(texts)))
    for row, margin in enumerate(machine.margins(places, bounds)):
        own = [int(machine.place[t]) for t in found[row]]
        assert own == places[bounds[row]:bounds[row + 1]].tolist()
        shrunk = [min(1, machine.radius / max(sum(s[t] ** 2 for t in own) ** 0.5, 1e-6)) for s in (machine.scale, machine.pair_scale)]
        want = machine.bias + shrunk[0] * sum(machine.weights[t] for t in own)
        for n, one in enumerate(own):
            for other in own[:n]:
                want += shrunk[1] ** 2 * float(machine.factors[one] @ machine.factors[other])
        assert abs(want - margin) < 1e-4


def test_terms_are_those_of_a_plain_count():
    """Words, their beginnings, and marks of repeats, as sets of hashes."""
    import pyarrow as pa
    from collections import Counter
    from tallywatch.llm import batches as B
    def number(text, size):
        data = np.frombuffer(text.encode(), np.uint8)
        stem = B.span_hashes(data, np.array([0]), np.array([min(len(data), size or len(data))]))
        return int((B.mix64(stem + np.uint64(size)) >> np.uint64(64 - toxicity.BITS))[0])
    text = "Alpha alpha, beta-beta beta beta gamma alphabetical"
    counts = Counter(number(w, size) for w in text.lower().replace(",", " ").replace("-", " ").split() for size in (0, *toxicity.STEMS))
    want = set(counts)
    for times in toxicity.REPEATS:
        want |= {int(toxicity._repeated(np.array([t]), times)[0]) for t, n in counts.items() if n >= times}
    assert toxicity.terms(pa.array([text]))[0].tolist() == sorted(want)


def either(first, last):
    """A text is toxic when it has one of two words but not both: either word is as common in both classes."""
    rows, labels = [], []
    for n in range(first, last):
        one, other = n % 2, n // 2 % 2
        common = " ".join(f"common{n * k % 41}" for k in range(1, 9))
        rows.append((n, f"{common} {prose(n, 12)}" + " rotten" * one + " villagers" * other))
        labels.append((n, one ^ other))
    return rows, labels


def test_pairs_of_words_as_common_in_both_classes_are_learned(spark):
    """At the production defaults, judged on texts that were not trained on."""
    (rows, labels), (fresh, truth) = either(0, 800), either(800, 1200)
    machine = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, fresh), machine).collect()}
    assert sum(got[d] == t for d, t in truth) >= 380


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def test_odd_rows_and_labels(spark):
    docs = frame(spark, messy())
    odd = labels_of(spark, [(1, None, None, "x"), (5, 1, 0, "x"), (5, 0, 1, "x"), (9, 0, 1, "x"), (None, 1, 1, "x"), (77, 1, 0, "x"),
                            (12, 3, 3, "x")])
    for labels in (odd, odd.where("false")):
        for module, train in ((toxicity, "toxic"), (quality, "quality")):
            model = module.train(docs, labels, train)
            scored = module.score(docs, model).collect()
            assert len(scored) == len(messy()) and all(0 <= r.score <= 1 for r in scored)
            kept = module.keep(docs, model)
            assert kept.columns == docs.columns
            assert module.score(frame(spark, []), model).count() == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, odd.where("false"))).collect()} == {0}


def test_the_risk_stays_non_negative():
    """With as many free parameters as rows the plain unbiased risk falls without end; the corrected one does not."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (60, 80)), np.concatenate([rng.normal(1, 1, (60, 80)), rng.normal(-1, 1, (60, 80))])
    model = quality.fit_pu(p, u, 0.5)
    on_p, on_u = model.margins(p), model.margins(u)
    negative = np.logaddexp(0, on_u).mean() - 0.5 * np.logaddexp(0, on_p).mean()
    assert negative > -0.2
    fresh = np.concatenate([rng.normal(1, 1, (200, 80)), rng.normal(-1, 1, (200, 80))])
    assert ((model.margins(fresh) > 0) == (np.arange(400) < 200)).mean() > 0.95


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = [t or "" for _, t in messy()]
    whole = quality.features(pa.array(texts))
    for n, text in enumerate(texts):
        assert np.allclose(quality.features(pa.array([text]))[0], whole[n], atol=1e-5)
    hashed, bounds = toxicity.terms(pa.array(texts))
    for n, text in enumerate(texts):
        assert toxicity.terms(pa.array([text]))[0].tolist() == hashed[bounds[n]:bounds[n + 1]].tolist()


def test_calibration_takes_all_sampled_negatives(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "calibrate", lambda model, x, labels, prior: seen.append(labels) or model)
    quality.train(frame(spark, [(n, prose(n, 5)) for n in range(1700)]), spark.createDataFrame([(n, int(n < 100)) for n in range(1700)], "doc_id long, quality int"))
    assert (seen[0] == 0).sum() == 1600
