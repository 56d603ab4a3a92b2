"""Suffix arrays and repeated strings against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.llm import repeats
from tallywatch.llm.repeats import remove_repeats
from tallywatch.llm.suffixes import suffix_array

from .helpers import frame, messy, prose, without_repeats


def result(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    return {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id is not None}


def test_suffix_arrays_are_sorted():
    rng = random.Random(1)
    for trial in range(600):
        text = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 40))]
        if trial % 6 == 0:
            text = text[:3] * 9
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(np.array(text, np.int64)).tolist() == want


def passages(seed):
    """Texts with shared passages at all offsets, periodic stretches, copies and other scripts."""
    rng = random.Random(seed)
    shared = [prose((seed, i), 30) for i in range(3)] + ["ab" * 200, "é日" * 60, "z" * 300]
    rows = []
    for n in range(50):
        text = ""
        for _ in range(rng.randint(1, 4)):
            piece = rng.choice(shared)
            start = rng.randrange(len(piece) // 2)
            text += piece[start: rng.randint(start, len(piece))] + rng.choice(["", " ", prose((seed, n), 3)])
        rows.append((n * 3, text))
    return rows + [(500, rows[0][1]), (501, rows[0][1])]


@pytest.mark.parametrize("window, most", [(100, 20_000), (100, 2), (64, 20_000)])
def test_repeats_equal_brute_force(spark, window, most):
    for seed in (1, 2):
        rows = passages(seed)
        assert result(remove_repeats(frame(spark, rows), window, most)) == without_repeats(rows, window)


def test_messy_rows(spark):
    out = remove_repeats(frame(spark, messy()))
    assert out.count() == len(messy())
    assert result(out) == without_repeats(messy(), 100)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[None] == b"text without id" and kept[0] == b""
    assert remove_repeats(frame(spark, [])).count() == 0


def test_one_document_read_twice_repeats_nothing_of_itself(spark):
    text = prose("twice", 80)
    assert result(remove_repeats(frame(spark, [(1, text), (1, text)])))[1][1] == 0


def test_digests_tell_where_the_anchor_stands(spark):
    """With a '|' beside one anchor, windows that begin at different offsets are different strings."""
    rest = b"r" * 67
    rows = [(5, 1, 100, 0, 0, b"", b"|" + rest), (5, 2, 100, 1, 1, b"|", rest), (5, 3, 100, 1, 1, b"|", rest)]
    flanked = spark.createDataFrame(rows, "anchor long, doc_id long, at long, least int, most int, left binary, right binary")
    assert [tuple(r) for r in repeats._by_fingerprints(flanked, 100).collect()] == [(3, 99, 1)]


def test_rows_that_share_an_id_but_not_a_text(spark):
    same = prose("same", 60)
    rows = [(1, same), (2, same + " a"), (2, "b " + prose("own", 60))]
    got = sorted((r.doc_id, r.n_removed, r.kept.decode()) for r in remove_repeats(frame(spark, rows)).collect())
    least = min(rows[1][1], rows[2][1])
    assert sum(n for _, n, _ in got) == (len(same) if least == rows[1][1] else 0)
    assert (2, 0, max(rows[1][1], rows[2][1])) in got


@pytest.mark.parametrize("window", [63, 113])
def test_windows_beyond_the_hashes_are_refused(spark, window):
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, messy()), window)
