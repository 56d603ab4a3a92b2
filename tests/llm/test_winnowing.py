"""Benchmark decontamination against plain search of every window."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywatch.llm import winnowing

from .helpers import frame, messy, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(rows, items, window=10):
    """(doc_id, words, hit words, items) of each row, by looking up every window."""
    runs = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size and item is not None else 0):
            runs[tuple(w[i:i + size])].add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(r) for r in runs}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in runs:
                    hit.update(range(i, i + size))
                    found |= runs[tuple(w[i:i + size])]
        out.append((str(doc), len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out)


def found(spark, docs, items, **options):
    rows = winnowing.decontaminate(docs, items, **options).collect()
    assert all(a.end < b.begin for r in rows for a, b in zip(r.spans, r.spans[1:]))
    return sorted((str(r.doc_id), r.n_words, tuple(p for s in r.spans for p in range(s.begin, s.end)), tuple(r.item_ids)) for r in rows)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, words string, key long")


def test_messy_rows_and_items(spark):
    same, long = prose("same", 60), prose("long", 6000)
    items = [(1, same), (1, same), (2, " ".join(long.split()[3000:3010]).upper()), (3, "One"), (4, "b c"), (5, None), (6, " -- "),
             (7, "日本語, 한국어"), (8, same[100:300]), (None, prose("q", 40)), (9, "nowhere to be found in any of the documents here"),
             (1, prose("r", 12)), (-3, "ab " * 9), (-4, "ab " * 12)]
    got = found(spark, frame(spark, messy()), item_frame(spark, items))
    assert got == plain(messy(), items)
    assert sum(bool(r[2]) for r in got) >= 8


def test_empty_tables(spark):
    docs, items = frame(spark, messy()), item_frame(spark, [(1, "one")])
    assert found(spark, docs, items.where("false")) == plain(messy(), [])
    assert found(spark, frame(spark, []), items) == []


@pytest.mark.parametrize("window, gram", [(10, 5), (6, 6), (4, 9), (7, 1)])
def test_random_texts_of_few_words(spark, window, gram):
    """Few different words: many ties, repeats and windows shared by items."""
    rng = random.Random(window)
    draw = lambda most: " ".join(rng.choice(["a", "B", "c", "9"]) for _ in range(rng.randrange(most)))
    rows, items = [(n, draw(90)) for n in range(60)], [(n, draw(22)) for n in range(25)]
    assert found(spark, frame(spark, rows), item_frame(spark, items), window=window, gram=gram) == plain(rows, items, window)


def test_a_common_passage_in_many_documents_and_items(spark):
    common = prose("common", 14)
    rows = [(n, f"{prose(n, 5)} {common if n % 3 else ''} {prose(-n, 5)}") for n in range(300)]
    items = [(n, f"{common} {prose('item' + str(n), 3)}") for n in range(200)]
    assert found(spark, frame(spark, rows), item_frame(spark, items)) == plain(rows, items)


def test_prints_guarantee_and_density(spark):
    """Every window keeps one of its runs, and about two of w + 1 runs are kept."""
    text = prose("density", 4000)
    rows = frame(spark, [(1, text)]).select(winnowing.words_of(F.col("text")).alias("words"))
    prints = winnowing.fingerprints(rows, 10, 5).select(F.inline("prints")).orderBy("first").collect()
    assert [p.first for p in prints[1:]] == [p.last + 1 for p in prints[:-1]]
    assert prints[0].first == 0 and prints[-1].last == 4000 - 10
    assert 0.2 < len(prints) / 3996 < 0.4


def test_the_main_path_is_native(spark):
    plan = winnowing.decontaminate(frame(spark, messy()), item_frame(spark, [(1, "one")]))._jdf.queryExecution().toString()
    for word in ("Python", "Arrow", "Pandas", "BroadcastNestedLoop", "CartesianProduct"):
        assert word not in plan
