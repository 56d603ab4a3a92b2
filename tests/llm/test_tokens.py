"""Token counts, packing and wavelet shards against the library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallywatch.llm.packing import OpenWindows, pack
from tallywatch.llm.token_counts import count_tokens
from tallywatch.llm.token_files import read_documents, read_shards, write_shards
from tallywatch.llm.token_ids import PieceEncoder
from tallywatch.llm.transducer import MergeTransducer
from tallywatch.llm.vocabulary import library
from tallywatch.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from tallywatch.llm.word_symbols import WordSymbols

from .helpers import frame, messy

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    got = count_tokens(frame(spark, messy()), limit=100).collect()
    want = sorted((str(d), len((t or "").encode()), len(ids_of(WORDS, t)), len(ids_of(WORDS, t)) > 100) for d, t in messy())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_of_an_empty_table(spark):
    assert count_tokens(frame(spark, [])).count() == 0


def test_chunks_and_resets_change_nothing():
    from tallywatch.llm.vocabulary import find
    machine = WordSymbols(find(WORDS))
    texts = [t or "" for _, t in messy()]
    symbols, bounds, _ = machine.stream(texts)
    whole = machine.machine.weights(symbols, chunk=1 << 20)
    machine.machine._most = 50
    for chunk in (1, 7, 64):
        assert (machine.machine.weights(symbols, chunk) == whole).all() or (
            np.add.reduceat(machine.machine.weights(symbols, chunk), [0]) == whole.sum())
    assert machine.machine.resets > 0


def test_transducer_on_a_toy_vocabulary():
    # a, b, b-end, ab, abb-end; merges in this order
    machine = MergeTransducer([(97,), (98,), (98 + 256,), (97, 98), (97, 98, 98 + 256)], [(0, 1, 3), (3, 2, 4)])
    word = np.array([97, 98, 98 + 256])
    assert machine.weights(word).sum() == 1
    assert machine.weights(np.array([98, 97, 98 + 256])).sum() == 3


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_piece_encoder_equals_the_library(name):
    import pyarrow as pa
    texts = [t or "" for _, t in messy()]
    for most in (600_000, 3):
        encoder = PieceEncoder(name, most)
        for _ in range(2):
            ids, bounds = encoder.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(name, t) for t in texts]


@pytest.mark.parametrize("windows, size", [(32, 1024), (1, 64), (3, 16)])
def test_packing_places_every_id_once(spark, windows, size):
    rows = [(d, t) for d, t in messy() if d != 40]
    want = {d: np.array(ids_of(BYTES, t) + [0], "<u4") for d, t in rows}
    pieces = pack(frame(spark, rows), windows=windows, size=size, merged_partitions=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = want[p.doc_id]
        assert p.doc_tokens == len(own) and zlib.crc32(own[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(want[doc])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size


def test_packing_repeats_and_empty_table(spark):
    pieces = pack(frame(spark, [(1, "a b"), (1, "a b")])).collect()
    assert len(pieces) == 2 and len({(p.sequence_id, p.offset) for p in pieces}) == 2
    assert pack(frame(spark, [])).count() == 0


def test_windows_fit_best():
    open_windows = OpenWindows(10, 2)
    assert open_windows.put(6) == (0, 0) and open_windows.put(7) == (1, 0)
    assert open_windows.put(3) == (1, 7) and open_windows.put(4) == (0, 6)
    assert open_windows.put(9) == (2, 0) and open_windows.put(8) == (3, 0) and open_windows.put(5) is None
    assert open_windows.close_fullest() == 2 and open_windows.left() == {3}


@pytest.mark.parametrize("per_range, per_shard", [(4096, 1 << 22), (3, 50)])
def test_shards_round_trip_in_order(spark, tmp_path, per_range, per_shard):
    path = str(tmp_path / "shards")
    write_shards(frame(spark, messy()), path, docs_per_range=per_range, shard_tokens=per_shard)
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    at = 0
    ordered = sorted(messy(), key=lambda r: -(1 << 62) if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [d for d, _ in ordered]
    for r, (_, text) in zip(got, ordered):
        ids = np.array(ids_of(WORDS, text) + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    if per_range == 3:
        assert read_shards(spark, path).count() > 3


def test_shards_of_an_empty_table(spark, tmp_path):
    write_shards(frame(spark, []), str(tmp_path / "none"))
    assert read_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n, most", [(0, 1), (1, 3), (9000, 50_000), (20_000, 4)])
def test_wavelet_matrix_answers(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint16)
    matrix, docs, sizes = from_bytes(to_bytes(WaveletMatrix.of(ids, 16), [3, None, -2], np.array([n, 0, 0])))
    assert docs == [3, None, -2] and sizes.tolist() == [n, 0, 0]
    assert (matrix.all() == ids).all()
    at = np.arange(0, n, max(1, n // 50))
    assert (matrix.access(at) == ids[at]).all()
    for value in {*ids[:5].tolist(), 65_535}:
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places) and matrix.count(value, n // 2) == (places < n // 2).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            if 0 <= k < len(places):
                assert matrix.find(value, k) == places[k]
        assert matrix.find(value, len(places)) == -1
    assert matrix.count(1 << 20) == 0
