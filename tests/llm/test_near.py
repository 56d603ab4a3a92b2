"""Near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tallywatch.llm.fingerprints import near_classes, with_edited
from tallywatch.llm.graph import components as graph_components
from tallywatch.llm.jaccard import jaccard_components
from tallywatch.llm.segments import band_of, bands_of, signatures

from .helpers import components, frame, messy, prose, shingles


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def variants(seed):
    """A base text and copies with growing numbers of changed words, short and long, and texts sharing one passage."""
    rng, rows = random.Random(seed), []
    for group, size in enumerate((4, 9, 14, 25, 60, 150)):
        base = prose((seed, group), size).split()
        for copy in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 12))):
                words[rng.randrange(size)] = rng.choice(["new", "words", str(copy)])
            rows.append(" ".join(words[: size - rng.randint(0, size // 20)]))
    passage = prose("passage", 30)
    rows += [passage + " " + prose((seed, "own", i), rng.randint(2, 8)) for i in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words, percent", [(3, 90), (1, 50)])
def test_join_equals_all_pairs(spark, words, percent):
    rows = variants(words)
    assert found(jaccard_components(frame(spark, rows), words, percent)) == components(rows, words, percent)


def test_join_of_messy_rows(spark):
    got = jaccard_components(frame(spark, messy()), 3, 90)
    want = components(messy(), 3, 90)
    assert found(got) == want
    assert got.count() == len(messy())
    none = [r for r in got.collect() if r.doc_id is None]
    assert len(none) == 1 and none[0].component_id is None
    assert found(jaccard_components(frame(spark, []))) == {}


def test_crowded_signatures_lose_nothing(spark):
    """Copies of one text, all changed in other places, share signatures without being in one component."""
    rng = random.Random(3)
    base = prose("crowd", 80).split()
    rows = [(n, " ".join(rng.choice(["x", "y", str(n)]) if rng.random() < 0.02 * (n % 5) else w for w in base)) for n in range(120)]
    assert found(jaccard_components(frame(spark, rows), 2, 80)) == components(rows, 2, 80)


@pytest.mark.parametrize("p, q", [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(p, q):
    """The pigeonhole holds pair by pair, at the threshold itself too."""
    rng = np.random.default_rng(p)
    for size in (1, 2, 5, 10, 11, 19, 40, 100, 333):
        for _ in range(20):
            base = rng.integers(0, 1 << 62, size).astype(np.uint64)
            dropped = rng.integers(0, size + 1)
            other = np.concatenate([base[dropped:], rng.integers(0, 1 << 62, rng.integers(0, size + 1)).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            shared = len(np.intersect1d(a, b))
            if not len(b) or q * shared < p * (len(a) + len(b) - shared) or len(a) == len(b) == shared:
                continue
            sigs, owner = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), p, q)
            # kinds 1 and 2 of one small content meet each other
            left, right = ({(int(s) >> 2, min(int(s) & 3, 1)) for s in sigs[owner == n]} for n in (0, 1))
            assert left & right


def test_bands_cover_all_sizes():
    bands = bands_of(100_000, 9, 10)
    assert bands[0].low == 1 and all(b.low == a.high + 1 for a, b in zip(bands, bands[1:]))
    assert all(b.segments >= b.differ + 1 for b in bands if b.differ) and band_of(0, 9, 10).differ == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.component for r in graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert graph_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_texts_and_likeness(spark):
    rows = [(d, t) for d, t in messy() if d != 40]
    ordered = sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0])
    for per_range in (4096, 2):
        got = {r.doc_id: r for r in with_edited(frame(spark, rows), docs_per_range=per_range).collect()}
        assert len(got) == len(rows)
        for place, (doc, text) in enumerate(ordered):
            text, after = text or "", ordered[(place + 1) % len(ordered)][1] or ""
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            r = got[doc]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b = shingles(text, 5), shingles(edited, 5)
            assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
            assert 0 <= r.near_next <= 1
        assert got[5].fingerprint == got[6].fingerprint == got[7].fingerprint != got[3].fingerprint


def test_edited_texts_of_one_row_repeats_and_none(spark):
    one = with_edited(frame(spark, [(3, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert with_edited(frame(spark, [(3, "abcd efgh"), (3, "abcd efgh")])).count() == 2
    assert with_edited(frame(spark, [])).count() == 0


def test_banded_classes_agree_with_the_exact_join(spark):
    rows = variants(2)
    got, want = found(near_classes(frame(spark, rows), 5, 90)), components(rows, 5, 90)
    assert sum(got[d] == want[d] for d in want) >= 0.97 * len(want)
    assert found(near_classes(frame(spark, messy()), 3, 90)) == components(messy(), 3, 90)
