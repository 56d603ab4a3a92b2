"""What a worker holds while it works, and what it leaves for later stages."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from tallywatch.llm import batches as B
from tallywatch.llm import toxicity
from tallywatch.llm.packing import BYTE_VOCABULARY
from tallywatch.llm.token_ids import encoder

from .helpers import prose


def texts(n, words):
    return pa.RecordBatch.from_arrays([pa.array([prose(f"memory {i}", words) for i in range(n)])], ["text"])


def machine(n):
    rng = np.random.default_rng(5)
    numbers = [rng.uniform(-1, 1, size).astype(np.float16) for size in (n, (n, 8))]
    known = np.sort(rng.choice(toxicity.SIZE, n, replace=False)).astype(np.int32)
    return toxicity.FactorizationMachine(-0.3, *numbers, *(rng.uniform(0, 1, n).astype(np.float16) for _ in range(2)), 3.0, known)


def test_a_vocabulary_goes_when_a_task_of_another_kind_begins():
    tokenizer = encoder(BYTE_VOCABULARY)
    list(B.slices([texts(3, 10)], using=BYTE_VOCABULARY))
    assert encoder(BYTE_VOCABULARY) is tokenizer
    there = weakref.ref(tokenizer)
    del tokenizer
    list(B.slices([texts(3, 10)]))
    assert there() is None


def test_a_worker_adds_only_the_places_of_terms_to_the_model():
    narrow = machine(500_000)
    tracemalloc.start()
    opened = narrow.opened()
    added, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert opened.place.nbytes <= added < 2 * opened.place.nbytes


def test_rating_holds_a_small_slice_at_once():
    """Of 4 MB of text, some 26 MB at most with all terms and factors of a slice."""
    part, model = texts(400, 2000), machine(500_000).opened()
    assert part.nbytes > 4 << 20
    tracemalloc.start()
    for piece in B.slices([part], most=toxicity.RATED_BYTES):
        model.scores(*toxicity.terms(piece.column("text")))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40 << 20, peak


def test_narrow_numbers_score_as_wide_ones():
    narrow = machine(500_000)
    wide = toxicity.FactorizationMachine(-0.3, *[a.astype(np.float32) for a in (narrow.weights, narrow.factors, narrow.scale, narrow.pair_scale)], 3.0, narrow.known)
    found = toxicity.terms(texts(40, 300).column("text"))
    assert (narrow.opened().scores(*found) == wide.opened().scores(*found)).all()


def sample(docs, each):
    rng = np.random.default_rng(9)
    hashed = np.concatenate([np.sort(rng.choice(toxicity.SIZE >> 1, each, replace=False)) for _ in range(docs)]).astype(np.int32)
    return hashed, np.arange(docs + 1) * each, np.arange(docs) % 2


def test_a_fit_holds_few_bytes_for_each_term_of_the_sample():
    found = sample(1500, 2000)
    tracemalloc.start()
    toxicity.fit(*found, 0.5, alone=1, together=1)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 240 << 20, peak


def test_first_factors_are_those_drawn_for_all_terms():
    wanted = np.random.default_rng(3).uniform(size=100_000) < 0.3
    whole = np.random.default_rng(7).normal(0, 0.02, (len(wanted), 8)).astype(np.float32)
    assert (toxicity._normal_rows(np.random.default_rng(7), wanted, 8) == whole[wanted]).all()


def test_what_a_task_held_is_given_back_when_it_has_ended(monkeypatch):
    gone = []

    def task(parts):
        array = np.zeros(1000)
        there.append(weakref.ref(array))
        for part in parts:
            yield part

    there = []
    monkeypatch.setattr(B, "give_back", lambda: gone.append(there[0]() is None))
    assert len(list(B.lean(task)([texts(1, 3)]))) == 1 and gone == [True]
