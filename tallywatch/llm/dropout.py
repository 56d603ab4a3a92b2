"""SentencePiece merges with seeded dropout: varied segmentations that decode to the same text."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from .fertility import PIECE_VOCABULARY
from .token_ids import PieceMemory
from .vocabulary import find

SPACE = "▁"
_NONE = np.int32(-1)
_WIDTHS = (3, 5, 7, 9, 11, 13, 16, 20, 28, 48)
_MOST_UNITS = 400_000
_LONG = 64
_CODES = 0x110000


def keyed(seed: int, key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for a candidate merge of [begin, middle) and [middle, end) in the unit with this key."""
    x = B.mix64(key + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    x = B.mix64(x + begin.astype(np.uint64) * np.uint64(0x10001) + (middle.astype(np.uint64) << np.uint64(21)) + (end.astype(np.uint64) << np.uint64(42)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_ALL = (1 << 64) - 1


def _mix_one(x: int) -> int:
    """``mix64`` of one number."""
    x &= _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _keyed_one(salted: int, begin: int, middle: int, end: int) -> float:
    """``keyed`` of one candidate, after the first mix of seed and key."""
    return (_mix_one(salted + begin * 0x10001 + (middle << 21) + (end << 42)) >> 11) / float(1 << 53)


class MergeModel:
    """Pieces, scores and pairs of a SentencePiece BPE file with byte fallback."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=find(vocabulary))
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.number = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.raw = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if not plain[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        order = sorted(self.number.values(), key=lambda i: (-model.get_score(i), i))
        rank = np.zeros(size, np.int64)
        last, place = None, -1
        for i in order:
            # pieces of equal score are equals: the leftmost pair goes first
            if model.get_score(i) != last:
                last, place = model.get_score(i), place + 1
            rank[i] = place
        pairs = {}
        for piece, whole in self.number.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = whole
        self._pairs = pairs
        self._order = rank.tolist()
        self._rank = rank.astype(np.int32)
        self._none = np.int32(rank.max() + 1)
        self._bits = max(8, 2 + len(pairs).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._whole = np.full(1 << self._bits, _NONE, np.int32)
        keys, whole = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._slot(keys)
        while len(keys):  # open addressing: one key takes a free place, the others try the next
            _, first = np.unique(np.where(self._keys[at] < 0, at, -1 - np.arange(len(at))), return_index=True)
            first = first[self._keys[at[first]] < 0]
            self._keys[at[first]], self._whole[at[first]] = keys[first], whole[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, whole, at = keys[rest], whole[rest], (at[rest] + 1) % len(self._keys)
        # neighbours inside some piece; a unit can be cut between any others
        point = lambda c: 32 if c == SPACE else ord(c)
        inner = np.array([(point(a), point(b)) for p in self.number for a, b in zip(p, p[1:])], np.int64).reshape(-1, 2)
        kinds = np.unique(inner)
        self._number = np.zeros(_CODES, np.int32)
        self._number[kinds] = np.arange(1, len(kinds) + 1)
        self._inner = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        self._inner[self._number[inner[:, 0]], self._number[inner[:, 1]]] = True
        # pieces of single characters: a space is the space mark, a space mark is none
        self._symbol = np.full(_CODES, _NONE, np.int32)
        for piece, i in self.number.items():
            if len(piece) == 1:
                self._symbol[point(piece)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """Whether a code point can only begin a piece, going by the one before it; the first one can."""
        kinds = self._number[codes]
        return np.concatenate([np.ones(min(len(codes), 1), bool), ~self._inner[kinds[:-1], kinds[1:]]])

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece two neighbours make, or -1."""
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        held = self._keys[at]
        made = np.where((held == key) & (left >= 0) & (right >= 0), self._whole[at], _NONE)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self._keys)
            held = self._keys[at[rest]]
            hit = rest[held == key[rest]]
            made[hit] = self._whole[at[hit]]
            rest = rest[(held != key[rest]) & (held >= 0)]
        return made

    def ranks(self, whole: np.ndarray) -> np.ndarray:
        return np.where(whole >= 0, self._rank[whole], self._none)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Pieces of single characters, -1 for those without."""
        return self._symbol[codes]

    def segment(self, codes: np.ndarray, bounds: np.ndarray, keys: np.ndarray, dropout: float, seed: int,
                met: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units given as code points, one after another, and how many each unit has.

        ``keys`` are the units' 64-bit keys. All candidates met are added to ``met``
        as columns unit, begin, middle and end. Units of like length are merged side
        by side, long ones on their own. A symbol left without a piece becomes
        the bytes of its character.
        """
        symbols, sizes = self.symbols(codes), np.diff(bounds)
        unit, at, made = [], [], []
        last = 0
        for most in _WIDTHS:
            rows = np.flatnonzero((sizes > last) & (sizes <= most))
            for first in range(0, len(rows), 40_000):
                for part, new in zip((unit, at, made), self._together(symbols, bounds, rows[first : first + 40_000], keys, dropout, seed, met)):
                    part.append(new)
            last = most
        for row in np.flatnonzero(sizes > last).tolist():
            begin, piece = self._alone(symbols[bounds[row] : bounds[row + 1]].tolist(), keys[row], dropout, seed, met, row)
            unit.append(np.full(len(begin), row))
            at.append(np.array(begin) + bounds[row])
            made.append(np.array(piece, np.int32))
        if not unit:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        unit, at, made = np.concatenate(unit), np.concatenate(at), np.concatenate(made)
        order = np.argsort(at, kind="stable")
        unit, at, made = unit[order], at[order], made[order]
        wide = np.ones(len(made), np.int64)
        bare = np.flatnonzero(made < 0)
        texts = {c: chr(c).encode() for c in B.distinct(codes[at[bare]]).tolist()}
        wide[bare] = [len(texts[c]) for c in codes[at[bare]].tolist()]
        out = np.repeat(made, wide)
        place = np.cumsum(wide) - wide
        for n in bare.tolist():
            data = texts[int(codes[at[n]])]
            out[place[n] : place[n] + len(data)] = [self.byte[b] for b in data]
        return out, np.bincount(unit, wide, len(sizes)).astype(np.int64)

    def _together(self, symbols: np.ndarray, bounds: np.ndarray, units: np.ndarray, keys: np.ndarray, dropout: float,
                  seed: int, met: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge some units side by side: in each step every unit merges its best candidate that is not skipped.

        Gives unit, first character and piece of all that is left, unit by unit.
        """
        size = bounds[units + 1] - bounds[units]
        n, width = len(units), int(size.max()) + 1
        column = np.arange(width, dtype=np.int32)
        inside = column < size[:, None]
        key, none = keys[units], self._none
        parts = np.where(inside, symbols[np.minimum(bounds[units][:, None] + column, len(symbols) - 1)], _NONE).ravel()
        # the places after and before a part, by the first character of each; the last part ends at the size
        after = np.minimum(column + 1, size[:, None].astype(np.int32)).ravel()
        before = np.tile(column - 1, n)
        stands = inside.ravel()
        whole = np.full(n * width, _NONE, np.int32)
        rank = np.full(n * width, none, np.int32)

        def weigh(row: np.ndarray, left: np.ndarray) -> None:
            """Candidates that begin at the given places: their piece and rank, or none if skipped."""
            spot = row * width + left
            right = after[spot]
            other = row * width + right
            made = self.joined(parts[spot], parts[other])
            if dropout > 0 or met is not None:
                there = np.flatnonzero(made >= 0)
                r, begin, middle, end = row[there], left[there], right[there], after[other[there]]
                if met is not None:
                    met.append(np.stack([units[r], begin, middle, end]))
                if dropout > 0:
                    made[there[keyed(seed, key[r], begin, middle, end) < dropout]] = _NONE
            whole[spot], rank[spot] = made, self.ranks(made)

        weigh(*np.nonzero(column < size[:, None] - 1))
        table, active = rank.reshape(n, width), np.arange(n)
        while True:
            best = (table if len(active) == n else table[active]).argmin(1)
            spot = active * width + best
            good = rank[spot] < none
            if not good.all():
                active, best, spot = active[good], best[good], spot[good]
            if not len(active):
                break
            gone = active * width + after[spot]
            parts[spot] = whole[spot]
            stands[gone], rank[gone] = False, none
            after[spot] = after[gone]
            before[active * width + after[spot]] = best
            weigh(active, best)
            left = before[spot]
            weigh(active[left >= 0], left[left >= 0])
        row, begin = np.divmod(np.flatnonzero(stands), width)
        return units[row], begin + bounds[units[row]], parts[stands]

    def _alone(self, symbol: list[int], key: np.uint64, dropout: float, seed: int, met: list[np.ndarray] | None = None,
               unit: int = 0) -> tuple[list[int], list[int]]:
        """First characters and pieces of a long unit: an agenda of candidate merges, best first; skipped and outdated ones are passed over."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        salted = _mix_one(int(key) + seed * 0x9E3779B97F4A7C15)
        order = self._order

        def offer(lefts: list[int]) -> None:
            found = []
            for left in lefts:
                right = after[left]
                if right < n and symbol[left] >= 0 and symbol[right] >= 0:
                    made = self._pairs.get(symbol[left] << 20 | symbol[right])
                    if made is not None:
                        found.append((order[made], left, right, after[right], made))
            if found and met is not None:
                met.append(np.array([(unit, *f[1:4]) for f in found]).T)
            if found and dropout > 0:
                if len(found) > 8:
                    spans = np.array([f[1:4] for f in found])
                    chance = keyed(seed, np.full(len(found), key, np.uint64), spans[:, 0], spans[:, 1], spans[:, 2]).tolist()
                else:
                    chance = [_keyed_one(salted, *f[1:4]) for f in found]
                found = [f for f, c in zip(found, chance) if c >= dropout]
            for f in found:
                heapq.heappush(agenda, f)

        offer(list(range(n - 1)))
        gone = bytearray(n)
        while agenda:
            _, left, right, end, made = heapq.heappop(agenda)
            if gone[left] or right >= n or gone[right] or after[left] != right or after[right] != end:
                continue
            symbol[left] = made
            gone[right] = 1
            after[left] = end
            if end < n:
                before[end] = left
            offer([left] if before[left] < 0 else [before[left], left])
        kept = [at for at in range(n) if not gone[at]]
        return kept, [symbol[at] for at in kept]


_models: dict[str, MergeModel] = {}


def model_of(vocabulary: str) -> MergeModel:
    if vocabulary not in _models:
        _models[vocabulary] = MergeModel(vocabulary)
    return _models[vocabulary]


def _codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of units given as UTF-8, and the bounds of the units in them."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), heads[bounds]


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class DropoutEncoder:
    """Encodes texts unit by unit; skips are drawn anew wherever a unit stands.

    A space is put in front of a text. It is cut into units wherever no piece of
    the vocabulary has the two characters side by side, as before a space that
    follows something else, or around most signs: no merge can cross there.
    Of units met lately the ids without skips are kept, with the candidates met on
    the way: where none of these is skipped, the ids are the kept ones.
    """

    def __init__(self, vocabulary: str, dropout: float, seed: int):
        self.model = model_of(vocabulary)
        self.dropout, self.seed = dropout, seed
        self._memory = PieceMemory(self._plain, _MOST_UNITS)
        # learns the same units in the same order, so a unit has one place in both
        self._candidates = PieceMemory(self._met, _MOST_UNITS)

    def _unskipped(self, units: list[bytes], met: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        codes, bounds = _codes(np.frombuffer(b"".join(units), np.uint8), bounds)
        return self.model.segment(codes, bounds, np.zeros(len(units), np.uint64), 0.0, self.seed, met)

    def _plain(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units without skips; the candidates met are kept for ``_met``, which is asked for the same units next."""
        self._last_met = [np.zeros((4, 0), np.int64)]
        return self._unskipped(units, self._last_met if self.dropout > 0 else None)

    def _met(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Begin, middle and end of each candidate that merging the units without skips meets."""
        every = np.concatenate(self._last_met, 1)
        self._last_met = []
        every = every[:, np.argsort(every[0], kind="stable")]
        return every[1:].T.astype(np.int32).ravel(), 3 * np.bincount(every[0], minlength=len(units))

    def encode(self, doc_ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their bounds."""
        data, bounds = B.flat_bytes(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes, code_bounds = _codes(data, bounds)
        begins = self.model.apart(codes)
        begins[code_bounds[:-1][np.diff(code_bounds) > 0]] = True
        first = np.flatnonzero((data & 0xC0) != 0x80)[begins]
        rows = np.searchsorted(first, bounds)
        starts, widths = first, np.diff(np.append(first, len(data)))
        # skips hang on the document and the place of the unit there
        row = np.repeat(np.arange(len(texts)), np.diff(rows))
        place = np.arange(len(first)) - rows[row]
        keys = B.mix64(doc_ids.astype(np.int64).view(np.uint64)[row] + B.mix64(place.astype(np.uint64) + np.uint64(self.seed)))
        # some candidate of a long unit is skipped nearly always
        skips = (widths > _LONG) & (self.dropout > 0)
        short = np.flatnonzero(~skips)
        known = np.zeros(len(first), np.int64)
        if len(short):
            ends = np.cumsum(widths[short])
            coded = B.binary_array(data[_within(starts[short], widths[short])], np.append(0, ends)).dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            known[short] = self._memory.places(pieces)[np.asarray(coded.indices)]
            if self.dropout > 0:
                self._candidates.places(pieces)
                for at in range(0, len(short), 100_000):
                    part = short[at : at + 100_000]
                    spans, counts = self._candidates.strung(known[part])
                    spans, own = spans.reshape(-1, 3), np.repeat(part, counts // 3)
                    chance = keyed(self.seed, keys[own], spans[:, 0], spans[:, 1], spans[:, 2])
                    skips[own[chance < self.dropout]] = True
        cut, kept = np.flatnonzero(skips), np.flatnonzero(~skips)
        sizes = np.zeros(len(first), np.int64)
        kept_ids, sizes[kept] = self._memory.strung(known[kept])
        cut_data = data[_within(starts[cut], widths[cut])]
        codes, code_bounds = _codes(cut_data, np.concatenate([[0], np.cumsum(widths[cut])]))
        cut_ids, sizes[cut] = self.model.segment(codes, code_bounds, keys[cut], self.dropout, self.seed)
        out_bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(out_bounds[-1], np.int32)
        for units, own in ((kept, kept_ids), (cut, cut_ids)):
            ids[_within(out_bounds[units], sizes[units])] = own
        return ids, out_bounds[rows]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put in front."""
        raw = self.model.raw
        data = b"".join([raw[i] for i in ids.tolist()])
        return data[1:].decode() if data else ""


def encode(docs: DataFrame, vocabulary: str = PIECE_VOCABULARY, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id and ids of every document, each candidate merge skipped with chance ``dropout``.

    Whether a candidate is skipped is a keyed hash of the seed, the document, the
    place there of the unit (a stretch that no merge can leave), and the
    candidate's place in it: each occurrence of a word is drawn on its own. So a text is cut
    the same way for the same seed on any cluster and otherwise for another one.
    With dropout 0 the ids are the library's. A space mark that stands in the
    text itself is written as bytes, which the library does not do, so that
    decoding gives every text back. Null and empty texts have no ids. A null
    doc_id counts as 0 in the choice. Other columns are not read.
    """
    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(vocabulary, dropout, seed)
        for part in B.slices(parts):
            doc_ids = np.asarray(part.column("doc_id").fill_null(0))
            ids, bounds = encoder.encode(doc_ids, part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return B.id_and_text(docs).mapInArrow(cut, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """doc_id and text of ids; null ids decode to an empty text."""
    def join(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = DropoutEncoder(vocabulary, 0.0, 0)
        for part in parts:
            texts = [decoder.decode(np.array(ids or [], np.int64)) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str = PIECE_VOCABULARY, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (little-endian 32-bit ids) and whether decoding gives the text back.

    Nulls, empty texts, repeats and other columns count as for ``encode``.
    """
    def check(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(vocabulary, dropout, seed)
        raw = np.array([len(r) for r in encoder.model.raw])
        table = np.frombuffer(b"".join(encoder.model.raw), np.uint8)
        start = np.concatenate([[0], np.cumsum(raw)])
        for part in B.slices(parts):
            data, text_bounds = B.flat_bytes(part.column("text"))
            doc_ids = np.asarray(part.column("doc_id").fill_null(0))
            ids, bounds = encoder.encode(doc_ids, part.column("text").to_pylist())
            # decode all at once: the bytes of every id, one after another
            sizes = raw[ids]
            decoded = table[np.repeat(start[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
            back = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            little = ids.astype("<u4")
            same = [
                decoded[a + (b > a) : b].tobytes() == data[c:d].tobytes()
                for a, b, c, d in zip(back[:-1], back[1:], text_bounds[:-1], text_bounds[1:])
            ]
            crcs = [zlib.crc32(little[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(text_bounds)), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()),
                 pa.array(same, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "restored"],
            )

    return B.id_and_text(docs).mapInArrow(
        check, "doc_id bigint, n_bytes bigint, n_tokens bigint, ids_crc32 bigint, restored boolean"
    )
