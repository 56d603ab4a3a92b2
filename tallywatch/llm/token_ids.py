"""Token ids by the tokenizers library, each distinct piece of text encoded once.

Texts are cut where the pre-tokenizer separates whatever stands on both sides.
Arrow numbers the distinct pieces of a slice, the library encodes those not met
lately, and numpy strings the ids together. The memory of pieces is bounded and
starts anew when full, which changes no result. A text that holds the opening of
a special string goes through the library whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import batches as B
from .vocabulary import find, library
from .word_symbols import byte_letters

MOST_PIECES = 600_000
_SIMPLE_BELOW = "ɐ"


def _kinds() -> np.ndarray:
    """0: not ASCII or control, 1: white space, 2: letter, 3: digit, 4: mark, 5: apostrophe"""
    kind = np.zeros(256, np.uint8)
    for code in range(0x21, 0x7F):
        char = chr(code)
        kind[code] = 2 if char.isalpha() else 3 if char.isdigit() else 5 if char == "'" else 4
    kind[[9, 10, 11, 12, 13, 32]] = 1
    return kind


def _cuts(drops_space: bool) -> np.ndarray:
    """Which pairs of neighbouring kinds may be cut apart, as a flat table.

    Where spaces belong to the tokens, a cut stands only before white space
    after a visible ASCII character; where they are dropped, on both sides.
    """
    cut = np.zeros((6, 6), bool)
    for one, other in ((2, 3), (2, 4), (3, 4)):
        cut[one, other] = cut[other, one] = True
    cut[2:, 1] = True
    if drops_space:
        cut[:, 1] = cut[1, :] = True
    return cut.ravel()


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the length of each."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum())), sizes


class PieceMemory:
    """Ids of pieces met lately: piece number -> ``ids[begin : begin + size]``. Full at ``most``, it starts anew.

    ``encode`` gives the ids of pieces one after another and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES):
        self._encode, self._most = encode, most
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self._used = 0

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Number of each piece, after learning those the memory lacked."""
        if len(self._known) > self._most:
            self._forget()
        known = self._known
        new = [p for p in pieces if p not in known]
        if new:
            encoded, sizes = self._encode(new)
            first = len(known)
            known.update(zip(new, range(first, first + len(new))))
            total = int(sizes.sum())
            while first + len(new) > len(self.begin):
                self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
            while self._used + total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self._used : self._used + total] = encoded
            self.begin[first : first + len(new)] = self._used + np.cumsum(sizes) - sizes
            self.size[first : first + len(new)] = sizes
            self._used += total
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def strung(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces one after another, and the ids of each."""
        sizes = self.size[place]
        shift = self.begin[place] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class PieceEncoder:
    def __init__(self, vocabulary: str, most_pieces: int = MOST_PIECES):
        self._library = library(vocabulary)
        with open(find(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        self._opening = {t["content"][:2] for t in spec["added_tokens"]}
        self._lower = spec["normalizer"] is not None
        self._model = self._library.model
        self._letters = {byte: letter for letter, byte in byte_letters().items()}
        self._kind, self._cut = _kinds(), _cuts(self._lower)
        self._memory = PieceMemory(self._encode, most_pieces)

    def _is_word(self, text: str) -> bool:
        """Letters of the simple blocks, composed and cased the same everywhere: one piece for the model."""
        letters = text[1:] if not self._lower and text[0] == " " else text
        return letters.isalpha() and (letters.isascii() or max(letters) < _SIMPLE_BELOW and "İ" not in letters)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces the memory lacks: plain words by the library's model, all else by its whole chain."""
        out: list[list[int] | None] = []
        rest, places = [], []
        for n, piece in enumerate(pieces):
            text = piece.decode()
            if self._is_word(text):
                data = text.lower().encode() if self._lower else piece
                out.append([t.id for t in self._model.tokenize(data.decode("latin-1").translate(self._letters))])
            else:
                out.append(None)
                rest.append(text)
                places.append(n)
        for n, found in zip(places, self._library.encode_batch_fast(rest, add_special_tokens=False)):
            out[n] = found.ids
        return flat(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after another, and the bounds of the texts."""
        data, bounds = B.flat_bytes(column)
        special = np.zeros(len(column), bool)
        for opening in self._opening:
            special |= np.asarray(pc.match_substring(column, opening).fill_null(False))
        row_of_piece_bounds, ids, sizes = self._encode_plain(data, bounds)
        token_bounds = np.concatenate([[0], np.cumsum(sizes)])[row_of_piece_bounds]
        if special.any():
            parts = []
            counts = np.diff(token_bounds)
            for row in np.flatnonzero(special):
                own = np.array(self._library.encode(column[row].as_py(), add_special_tokens=False).ids, np.int32)
                parts.append((row, own))
                counts[row] = len(own)
            pieces, at = [], 0
            for row, own in parts:
                pieces += [ids[token_bounds[at] : token_bounds[row]], own]
                at = row + 1
            pieces.append(ids[token_bounds[at] :])
            return np.concatenate(pieces), np.concatenate([[0], np.cumsum(counts)])
        return ids, token_bounds

    def _encode_plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the rows in the list of pieces, ids, and ids of each piece."""
        if not len(data):
            return np.zeros(len(bounds), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        kind = self._kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self._cut[kind[:-1] * np.uint8(6) + kind[1:]]
        cut[bounds] = True
        if self._lower:
            keep = kind != 1
            kept = np.concatenate([[0], np.cumsum(keep)])
            data = B.lower_ascii(data[keep])
            positions = B.distinct(kept[np.flatnonzero(cut)])
            bounds = kept[bounds]
        else:
            positions = np.flatnonzero(cut)
        if not len(data):
            return np.zeros(len(bounds), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = B.binary_array(data, positions).dictionary_encode()
        place = self._memory.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        ids, sizes = self._memory.strung(place)
        return np.searchsorted(positions, bounds), ids, sizes


def encoder(vocabulary: str, most_pieces: int = MOST_PIECES) -> PieceEncoder:
    """The encoder of a file, held in the process until a task cuts slices for something else."""
    return B.held(vocabulary, lambda: PieceEncoder(vocabulary, most_pieces))
