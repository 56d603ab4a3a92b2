"""Quality rules: counts of words, marks and repeats, and tokeniser fertility with bands for each script."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from .token_ids import PieceMemory, flat
from .vocabulary import find

PIECE_VOCABULARY = "piece_bpe_32k.model"

# fixed values: first code point of each script's main blocks
SCRIPT_STARTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"),
    (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "none"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x1F000, "none"), (0x20000, "han"),
]
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "han", "kana", "hangul", "other"]


@dataclass(frozen=True)
class Band:
    """What a document may measure: characters per token, share of byte tokens, and token entropy in bits.

    The entropy asked of a short document is ``entropy_share`` of the most its
    number of tokens allows, if that is less; its characters per token may fall
    below the band by the factor ``short_slack``, since a few numbers weigh much.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    entropy_share: float = 0.55
    short_tokens: int = 100
    short_slack: float = 0.7


_WIDE = Band(0.25, 8.0, 0.9, 3.0)
BANDS = {
    "latin": Band(1.55, 6.5, 0.25, 4.0),
    "greek": Band(0.8, 5.0, 0.5, 3.5),
    "cyrillic": Band(1.2, 6.0, 0.4, 3.5),
    "hebrew": Band(0.5, 4.0, 0.8, 3.0),
    "arabic": Band(0.5, 4.0, 0.8, 3.0),
    "devanagari": Band(0.3, 4.0, 0.9, 3.0),
    "thai": Band(0.3, 4.0, 0.9, 3.0),
    "han": Band(0.3, 3.0, 0.9, 3.5),
    "kana": Band(0.3, 3.0, 0.9, 3.5),
    "hangul": Band(0.3, 3.0, 0.9, 3.5),
}

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_KINDS = np.array([SCRIPTS.index(k) for _, k in SCRIPT_STARTS])


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(bounds) - 1
    starts, ends, words = B.word_spans(data, bounds)
    row = np.repeat(np.arange(n), np.diff(bounds))
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_row = np.repeat(np.arange(n), np.diff(words))
    out = {
        "n_words": np.diff(words),
        "word_chars": np.bincount(word_row, heads[ends] - heads[starts], n).astype(np.int64),
        "n_symbols": np.bincount(row, _MARK[data], n).astype(np.int64),
    }
    # lines: a break belongs to none of the two
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([bounds[1:], breaks]))
    line_row = np.sort(np.concatenate([np.arange(n), row[breaks]]))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_row = line_starts[worded], line_ends[worded], line_row[worded]
    _, distinct = B.distinct_in_rows(B.span_hashes(data, line_starts, line_ends), line_row, n)
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.diff(distinct)
    out["n_repeat_words"] = _repeated_words(B.span_hashes(data, starts, ends), words, 5)
    return out


def _repeated_words(hashed: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Words of each row that lie in a run of ``size`` words found twice or more in the row."""
    n = len(bounds) - 1
    long = np.diff(bounds) >= size
    windows, window_bounds = B.shingle_hashes(hashed, bounds, size)
    window_row = np.repeat(np.arange(n), np.diff(window_bounds))
    order = np.lexsort((windows, window_row))
    w, r = windows[order], window_row[order]
    same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= long[window_row]
    first = (bounds[:-1][window_row] + np.arange(len(windows)) - window_bounds[:-1][window_row])[twice]
    change = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return np.diff(covered[bounds])


def scripts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of the script with the most letters in each text, 0 without letters."""
    n = len(bounds) - 1
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(n), np.diff(heads[bounds]))
    kind = _KINDS[np.searchsorted(_STARTS, codes, "right") - 1]
    table = np.bincount(row * len(SCRIPTS) + kind, minlength=n * len(SCRIPTS)).reshape(n, -1)
    table[:, 0] = 0
    return np.where(table.any(1), table.argmax(1), 0)


class Fertility:
    """How a SentencePiece vocabulary cuts the words of texts; each word is encoded as it stands after a space."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=find(vocabulary))
        self._memory = PieceMemory(lambda words: flat(model.encode([w.decode() for w in words], num_threads=1)))
        self._is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

    def measure(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """n_tokens, n_byte_tokens and token entropy (bits) of each text."""
        n = len(words) - 1
        if not len(starts):
            return {"n_tokens": np.zeros(n, np.int64), "n_byte_tokens": np.zeros(n, np.int64), "entropy": np.zeros(n)}
        # words alone, without what lies between them
        sizes = ends - starts
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        joined = data[np.repeat(starts - cuts[:-1], sizes) + np.arange(cuts[-1])]
        coded = B.binary_array(joined, cuts).dictionary_encode()
        place = self._memory.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        ids, tokens = self._memory.strung(place)
        row = np.repeat(np.repeat(np.arange(n), np.diff(words)), tokens)
        total = np.bincount(row, minlength=n)
        pairs, times = np.unique(row.astype(np.int64) << 32 | ids, return_counts=True)
        own = pairs >> 32
        share = times / total[own]
        return {
            "n_tokens": total, "n_byte_tokens": np.bincount(row, self._is_byte[ids], n).astype(np.int64),
            "entropy": -np.bincount(own, share * np.log2(share), n),
        }


def within(script: np.ndarray, chars: np.ndarray, tokens: np.ndarray, byte_tokens: np.ndarray, entropy: np.ndarray,
           bands: dict[str, Band]) -> np.ndarray:
    """Whether each text's fertility lies in the band of its script."""
    table = [bands.get(name, _WIDE) for name in SCRIPTS]
    of = lambda name: np.array([getattr(b, name) for b in table])[script]
    per_token = chars / np.maximum(tokens, 1)
    asked = np.minimum(of("least_entropy"), of("entropy_share") * np.log2(np.maximum(tokens, 2)))
    least = of("least_chars") * np.where(tokens < of("short_tokens"), of("short_slack"), 1.0)
    return (
        (tokens > 0) & (per_token >= least) & (per_token <= of("most_chars"))
        & (byte_tokens <= of("most_bytes") * tokens) & (entropy >= asked)
    )


_vocabularies: dict[str, Fertility] = {}


def quality_rules(docs: DataFrame, vocabularies: tuple[str, ...] = (PIECE_VOCABULARY,),
                  bands: dict[str, Band] | None = None, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """Counts and verdict for every document, in one pass over whole texts without a shuffle.

    Base: word_chars (code points in words), n_symbols (characters of
    ``[#*$%&|<>]``), n_dup_lines (lines with a word, equal to an earlier one) and
    n_repeat_words (words in 5-word windows found twice or more). base_failed:
    fewer than ``least_words`` words, or more than ``most_repeated`` percent of
    them repeated. kept: not base_failed, and for every vocabulary the characters
    per token, the share of byte-fallback tokens and the token entropy lie in the
    band of the document's main script.

    Measured too: script, chars_per_token, byte_share and token_entropy of the
    first vocabulary. Null and empty texts have 0 words and fail the base. One
    row for each input row; null ids are kept and other columns not read.
    """
    chosen = BANDS if bands is None else bands

    def rate(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts):
            data, bounds = B.flat_bytes(part.column("text"))
            base = base_counts(data, bounds)
            starts, ends, words = B.word_spans(data, bounds)
            script = scripts(data, bounds)
            failed = (base["n_words"] < least_words) | (100 * base["n_repeat_words"] > most_repeated * base["n_words"])
            kept = ~failed
            shown = None
            for name in vocabularies:
                if name not in _vocabularies:
                    _vocabularies[name] = Fertility(name)
                m = _vocabularies[name].measure(data, starts, ends, words)
                kept &= within(script, base["word_chars"], m["n_tokens"], m["n_byte_tokens"], m["entropy"], chosen)
                shown = shown or m
            tokens = np.maximum(shown["n_tokens"], 1)
            columns = {
                "doc_id": part.column("doc_id"), **{k: pa.array(v) for k, v in base.items()},
                "script": pa.array(np.array(SCRIPTS)[script]), "chars_per_token": pa.array(base["word_chars"] / tokens),
                "byte_share": pa.array(shown["n_byte_tokens"] / tokens), "token_entropy": pa.array(shown["entropy"]),
                "base_failed": pa.array(failed), "kept": pa.array(kept),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return B.id_and_text(docs).mapInArrow(
        rate, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "script string, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean"
    )
