"""Texts as the symbols that the word tokenizer merges: lower-case UTF-8 bytes, marked at word ends."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from . import batches as B
from .transducer import END, MergeTransducer

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable bytes as themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class WordSymbols:
    """Symbol streams and the transducer of a lower-casing word tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        suffix, letters = model["end_of_word_suffix"], byte_letters()
        symbols: dict[str, tuple[int, ...]] = {}
        for letter, byte in letters.items():
            symbols[letter], symbols[letter + suffix] = (byte,), (byte + END,)
        number = {piece: i for i, piece in enumerate(symbols)}
        merges = []
        for left, right in model["merges"]:
            whole = left + right
            if whole not in symbols:
                symbols[whole] = symbols[left] + symbols[right]
                number[whole] = len(number)
            merges.append((number[left], number[right], number[whole]))
        self.machine = MergeTransducer(list(symbols.values()), merges)
        self._known = np.zeros(0x110000, bool)
        self._lower = np.arange(0x110000, dtype=np.uint32)
        self._class = np.zeros(0x110000, np.uint8)
        self._odd = np.zeros(0x110000, bool)

    def _learn(self, code: int) -> None:
        """Lower case and class of one character, as the library's own parts give them."""
        char = chr(code)
        lower = self._library.normalizer.normalize_str(char)
        self._known[code] = True
        if len(lower) != 1:
            self._odd[code] = True
            return
        self._lower[code] = ord(lower)
        pieces = lambda s: self._library.pre_tokenizer.pre_tokenize_str(s)
        if not pieces(lower):
            self._class[code] = _SPACE
        elif len(pieces("a" + lower)) == 1:
            self._class[code] = _LETTER
        elif len(pieces("!" + lower)) == 1:
            self._class[code] = _OTHER
        else:
            self._class[code] = _NUMBER

    def _learn_all(self, codes: np.ndarray) -> None:
        seen = self._known[codes]
        if not seen.all():
            for code in B.distinct(codes[~seen]):
                self._learn(int(code))

    def _plain(self, text: str) -> tuple[str, int]:
        """The text without special strings, composed, and how many special strings it had."""
        found = 0
        if "<|" in text:
            for special in self.specials:
                found += text.count(special)
                text = text.replace(special, " ")
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = self._library.normalizer.normalize_str(text)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self._learn_all(codes)
            if self._odd[codes].any():
                text = self._library.normalizer.normalize_str(text)
        return text, found

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, the bounds of each text in them, and special strings found in each."""
        plain = [self._plain(t) for t in texts]
        codes = np.frombuffer("".join(t + " " for t, _ in plain).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(t) + 1 for t, _ in plain), np.int64, len(plain))
        specials = np.fromiter((n for _, n in plain), np.int64, len(plain))
        text_ends = np.cumsum(sizes)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(1, np.int64), specials
        self._learn_all(codes)
        low, kind = self._lower[codes], self._class[codes]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        self._contractions(low, kind, begins)
        ends = kind != _SPACE
        ends[:-1] &= begins[1:] | (kind[1:] == _SPACE)
        if low.max() < 128:
            keep = kind != _SPACE
            symbols = low[keep].astype(np.int64) + END * ends[keep]
            kept = np.concatenate([[0], np.cumsum(keep)])
        else:
            width = 1 + (low > 0x7F).astype(np.int64) + (low > 0x7FF) + (low > 0xFFFF)
            data = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            upto = np.cumsum(width)
            end_bytes = np.zeros(len(data), bool)
            end_bytes[upto[ends] - 1] = True
            keep = np.repeat(kind != _SPACE, width)
            symbols = data[keep].astype(np.int64) + END * end_bytes[keep]
            kept = np.concatenate([[0], np.cumsum(np.where(kind != _SPACE, width, 0))])
        return symbols, np.concatenate([[0], kept[text_ends]]), specials

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that begins a word takes s, t, m, d, re, ve or ll with it."""
        at = np.flatnonzero((low == 39) & begins)
        at = at[at + 1 < len(low)]
        if not len(at):
            return
        one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[at[short | long] + 1] = False
        for hit, size in ((short, 2), (long, 3)):
            after = at[hit] + size
            after = after[after < len(low)]
            begins[after] |= kind[after] == _LETTER

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        symbols, bounds, specials = self.stream(texts)
        total = np.concatenate([[0], np.cumsum(self.machine.weights(symbols), dtype=np.int64)])
        return np.diff(total[bounds]) + specials
