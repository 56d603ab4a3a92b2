"""Quality rules against plain counts, and merge dropout against the library and its own round trip."""

import re
from collections import Counter

import numpy as np
import pytest

from tallywatch.llm.batches import mix64
from tallywatch.llm.dropout import DropoutEncoder, decode, encode, keyed, round_trip
from tallywatch.llm.fertility import BANDS, Band, quality_rules
from tallywatch.llm.vocabulary import find

from .helpers import WORD, frame, messy, prose

PIECES = "piece_bpe_32k.model"


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_base_counts(spark):
    rows = messy() + [(70, "a b c d e f a b c d e"), (71, "# $ %%\n# $ %%\n \n"), (72, "x y\nx y\nz\n" * 5)]
    got = quality_rules(frame(spark, rows)).collect()
    shown = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert shown == sorted((str(d), *base(t)) for d, t in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules(frame(spark, [])).count() == 0


def test_fertility_bands_reject_by_script(spark):
    english = ("the people of this country have always known that water and bread are worth more than gold when winter "
               "comes early and the roads are closed for many weeks at a time")
    cyrillic = "все люди этой страны всегда знали что вода и хлеб дороже золота когда зима приходит рано и дороги закрыты"
    noise = " ".join(f"q{i}x#{i * 7919 % 1000}zk" for i in range(40))
    rows = [(1, english), (2, cyrillic), (3, noise), (4, " ".join(["abracadabra", "hocus"] * 1 + ["pocus"] * 30))]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept and not got[4].kept
    assert (got[1].script, got[2].script) == ("latin", "cyrillic")
    assert got[1].chars_per_token > 3 > got[3].chars_per_token and got[1].byte_share == 0
    tight = quality_rules(frame(spark, rows), bands={**BANDS, "latin": Band(9, 10, 0, 0)}).collect()
    assert {r.doc_id for r in tight if r.kept} == {2}


def test_without_dropout_the_ids_are_the_librarys():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=find(PIECES))
    texts = [t or "" for _, t in messy() if "▁" not in (t or "")] + ["a" * 100 + " b", "\n\n", "  lead and trail  "]
    ids, bounds = DropoutEncoder(PIECES, 0.0, 1).encode(np.arange(len(texts)), texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [model.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_every_text_comes_back(spark, dropout):
    docs = frame(spark, messy())
    made = encode(docs, dropout=dropout)
    back = {(r.doc_id, r.text) for r in decode(made).collect()}
    assert back == {(d, t or "") for d, t in messy()}
    checked = round_trip(docs, dropout=dropout).collect()
    assert len(checked) == len(messy()) and all(r.restored for r in checked)
    assert round_trip(frame(spark, [])).count() == 0


def test_seeds_vary_and_repeat():
    texts, ids = [prose("vary", 300)], np.arange(1)
    first = DropoutEncoder(PIECES, 0.2, 1).encode(ids, texts)[0]
    again = DropoutEncoder(PIECES, 0.2, 1).encode(ids, texts)[0]
    other = DropoutEncoder(PIECES, 0.2, 2).encode(ids, texts)[0]
    plain = DropoutEncoder(PIECES, 0.0, 1).encode(ids, texts)[0]
    assert first.tolist() == again.tolist() != other.tolist()
    assert len(plain) < len(first)


def test_every_occurrence_is_drawn_on_its_own():
    """Segmentations of one word grow with its occurrences, and each is what merging with that place's key gives."""
    encoder, times = DropoutEncoder(PIECES, 0.1, 1), 2000
    ids, bounds = encoder.encode(np.arange(times), ["international"] * times)
    ways = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    plain = tuple(DropoutEncoder(PIECES, 0.0, 1).encode(np.arange(1), ["international"])[0].tolist())
    assert len(ways) > 20 and 0.05 < ways[plain] / times < 0.95
    keys = mix64(np.arange(times).astype(np.uint64) + mix64(np.array([1], np.uint64)))
    word = " international"
    codes = np.frombuffer((word * times).encode("utf-32-le"), "<u4")
    slow, sizes = encoder.model.segment(codes, np.arange(times + 1) * len(word), keys, 0.1, 1)
    assert slow.tolist() == ids.tolist() and sizes.tolist() == np.diff(bounds).tolist()


def test_long_units_merge_as_short_ones():
    """The agenda of a long unit and the side-by-side merges give the same pieces."""
    model = DropoutEncoder(PIECES, 0.3, 5).model
    units = [" " + w for w in prose("units", 400).split()]
    codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
    bounds = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    keys = np.arange(len(units)).astype(np.uint64)
    ids, sizes = model.segment(codes, bounds, keys, 0.3, 5)
    at = np.concatenate([[0], np.cumsum(sizes)])
    symbols = model.symbols(codes)
    for n in range(len(units)):
        assert model._alone(symbols[bounds[n]:bounds[n + 1]].tolist(), keys[n], 0.3, 5)[1] == ids[at[n]:at[n + 1]].tolist()


def plain_ids(text, doc_id, dropout, seed):
    """Best pair first, leftmost among equals, each candidate skipped by its keyed hash; a scan of the whole unit every time."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=find(PIECES))
    usable = {model.id_to_piece(i): i for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    beside = {a + b for p in usable for a, b in zip(p, p[1:])}
    # a space is written as the space mark; a space mark of the text as something no piece has
    marked = (" " + text).replace("▁", "\0").replace(" ", "▁") if text else ""
    units = []
    for c in marked:
        if units and units[-1][-1] + c in beside:
            units[-1] += c
        else:
            units.append(c)
    out = []
    for place, unit in enumerate(units):
        key = mix64(np.array([doc_id], np.int64).view(np.uint64) + mix64(np.array([place + seed], np.uint64)))
        parts = [(n, c) for n, c in enumerate(unit)]
        skipped = {}
        while True:
            best = None
            for n in range(len(parts) - 1):
                made = parts[n][1] + parts[n + 1][1]
                if made in usable and all(p in usable for p in (parts[n][1], parts[n + 1][1])):
                    span = (parts[n][0], parts[n + 1][0], parts[n + 1][0] + len(parts[n + 1][1]))
                    if span not in skipped:
                        skipped[span] = keyed(seed, key, *[np.array([x]) for x in span])[0] < dropout
                    if not skipped[span] and (best is None or model.get_score(usable[made]) > best[0]):
                        best = (model.get_score(usable[made]), n, made)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [(parts[best[1]][0], best[2])]
        for _, piece in parts:
            data = "▁" if piece == "\0" else piece
            out += [usable[piece]] if piece in usable else [model.piece_to_id(f"<0x{b:02X}>") for b in data.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.15, 0.6])
def test_ids_are_those_of_a_plain_agenda(dropout):
    texts = [(t or "")[:400] for _, t in messy()] + ["a\tb\n\ncd  ef 12345 <0x41> x▁y ▁ z", "e" * 120, "'international' (internationalisation)!"]
    ids, bounds = DropoutEncoder(PIECES, dropout, 3).encode(np.arange(len(texts)), texts)
    for n, text in enumerate(texts):
        assert ids[bounds[n]:bounds[n + 1]].tolist() == plain_ids(text, n, dropout, 3), text[:40]


def test_unspaced_text_is_fast():
    import random
    import time
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    encoder, start = DropoutEncoder(PIECES, 0.1, 1), time.process_time()
    ids, _ = encoder.encode(np.arange(1), [text])
    assert encoder.decode(ids) == text and time.process_time() - start < 2
