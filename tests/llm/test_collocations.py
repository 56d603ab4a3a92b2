"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallywatch.llm import collocations as C

from .helpers import messy

BREAK = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")
UPPER = {c: c + 32 for c in range(65, 91)}
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, most_words, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in BREAK.split((text or "").translate(UPPER)):
            w = WORD.findall(piece)
            totals[lang] += len(w)
            for size in range(1, most_words + 1):
                counts[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        longest = Counter()
        for q, n in f.items():
            if n >= least and len(q) > 2:
                for size in range(2, len(q)):
                    for i in range(len(q) - size + 1):
                        longest[q[i:i + size]] = max(longest[q[i:i + size]], n)
        found = []
        for p, a in f.items():
            if a >= least and len(p) > 1 and not (longest[p] and 100 * longest[p] >= cover * a):
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase, -a, l, r, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    full = [(n, t, lang, 1, "x", 2, "y") for n, (lang, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, f long, kind string, id long, phrase string"
    return (spark.createDataFrame(full, schema) if full else spark.createDataFrame([], schema)).repartition(3)


def got(frame):
    return sorted(tuple(r[n] for n in NAMES) for r in frame.collect())


def drawn(seed, n, words, most):
    rng = random.Random(seed)
    marks = ["", "", "", "", ".", ",", "\n", "\x0b", "\t", "  "]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [" ".join(w + rng.choice(marks) for w in rng.choices(words, weights, k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("head", [3, 1 << 16])
def test_random_texts(spark, head):
    """With few ranks nearly all units go as sorted coordinates; with many all have ranks."""
    words = ["The", "of", "À", "b", "日本", "c-d", "e\x1cf", "'g'", "h", "I", "j"]
    rows = [(lang, t) for seed, lang in enumerate(["en", None, "fr", "und"]) for t in drawn(seed, 60, words, 60)]
    rows += [("en", t) for _, t in messy()] + [(None, None), ("", "a b " * 400), ("xx", "one two three four five. " * 40), ("long", "p q r s t " * 9000)]
    found = C.collocations(frame(spark, rows), least=8, top=25, head=head)
    assert got(found) == plain(rows, 8, 4, 80, 25)


def test_other_lengths_and_limits(spark):
    rows = [("en", t) for t in drawn(9, 150, list("abcdefg"), 40)]
    for least, most_words, cover in ((5, 2, 80), (4, 3, 50), (6, 5, 95), (10**6, 4, 80)):
        found = C.collocations(frame(spark, rows), least=least, most_words=most_words, cover=cover)
        assert got(found) == plain(rows, least, most_words, cover, 2000)
    assert got(C.collocations(frame(spark, []))) == []


def test_scores_pass_64_bits(spark):
    """2000000 a stays exact where it does not fit a long."""
    units = spark.createDataFrame([(1, "en", "a b", "b", 9 * 10**18, 2, [9 * 10**18 + 1, 9 * 10**18], [9 * 10**18 + 3, 9 * 10**18], [])],
                                  "id long, kind string, phrase string, last string, f long, words int, heads array<long>, tails array<long>, inside array<long>")
    totals = spark.createDataFrame([("en", 5)], "kind string, n long")
    before, C.phrase_counts = C.phrase_counts, lambda *a: (units, totals)
    try:
        row, = C.collocations(units).collect()
    finally:
        C.phrase_counts = before
    assert row.score == 2000000 * 9 * 10**18 // (18 * 10**18 + 4)


def test_tiles_count_as_plain_counts_do():
    rng = np.random.default_rng(3)
    head = rng.integers(0, 2**63, 2000).astype(np.uint64)
    level = C.Level(np.zeros(8192, np.uint8), head)
    others = rng.integers(0, 2**63, 50).astype(np.uint64)
    pool = np.concatenate([head, others])
    pick = lambda n: pool[np.minimum(rng.zipf(1.3, n) - 1, len(pool) - 1)]
    left, right = pick(300_000), pick(300_000)
    want = Counter(zip(left.tolist(), right.tolist()))
    found, parts = Counter(), list(C.tile_counts(left, right, level))
    for a, b, n in parts:
        for x, y, times in zip(a.tolist(), b.tolist(), n.tolist()):
            assert (x, y) not in found
            found[x, y] = times
    assert found == want and len(parts) >= 3


def test_frequent_units_always_pass(spark):
    ids = np.random.default_rng(1).integers(-2**63, 2**63, 9000)
    units = spark.createDataFrame([(int(i), n) for n, i in enumerate(ids)], "id long, f long")
    level = C.level_of(units, head=100)
    assert level.frequent(ids.view(np.uint64)).all() and len(level.head) == 100
    assert level.ranks(ids[-3:].view(np.uint64)).tolist() == [2, 1, 0]
    assert level.ranks(ids[:1].view(np.uint64)).tolist() == [-1]
    assert level.frequent(np.arange(10**5, dtype=np.uint64) * np.uint64(2654435761)).mean() < 0.2
    assert C.level_of(units.where("false")) is None
