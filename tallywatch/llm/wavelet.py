"""Token ids as wavelet matrices: one compressed, searchable file for each shard."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TWWM0001"
_BLOCK = 4096


class BitPlane:
    """Bits with rank and select; every 4096 bits a count of the ones before is stored."""

    def __init__(self, packed: np.ndarray, n: int, blocks: np.ndarray | None = None):
        self.n = n
        self.packed = packed
        if blocks is None:
            ones = np.bitwise_count(packed).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(ones)])
            blocks = upto[np.minimum(np.arange(0, n + 1, _BLOCK) // 8, len(packed))].astype("<u4")
        self.blocks = blocks
        self._bytes: np.ndarray | None = None

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        return cls(np.packbits(bits, bitorder="little"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        block = at // _BLOCK
        first = block * (_BLOCK // 8)
        count = self.blocks[block].astype(np.int64)
        width = int((at // 8 - first).max(initial=0))
        if width * at.size > 1 << 16:
            return self._rank_by_bytes(at)
        span = first[..., None] + np.arange(width)
        inside = span < (at // 8)[..., None]
        values = np.bitwise_count(self.packed[np.minimum(span, len(self.packed) - 1)]).astype(np.int64)
        return count + (values * inside).sum(-1) + self._part(at)

    def _part(self, at: np.ndarray) -> np.ndarray:
        last = self.packed[np.minimum(at // 8, max(len(self.packed) - 1, 0))] if len(self.packed) else np.zeros_like(at, np.uint8)
        mask = ((1 << (at % 8)) - 1).astype(np.uint8)
        return np.bitwise_count(last & mask).astype(np.int64)

    def _rank_by_bytes(self, at: np.ndarray) -> np.ndarray:
        if self._bytes is None:
            self._bytes = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])
        return self._bytes[at // 8] + self._part(at)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = int(self.rank1(np.array([mid + 1]))[0])
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low


class WaveletMatrix:
    """Sequence of ids below 2**levels; planes run from the highest bit to the lowest."""

    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n = planes, n
        self.zeros = [p.n - int(p.rank1(np.array([p.n]))[0]) if p.n else 0 for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes = []
        for level in range(levels - 1, -1, -1):
            bits = ((ids >> ids.dtype.type(level)) & ids.dtype.type(1)).view(ids.dtype).astype(bool)
            planes.append(BitPlane.of(bits))
            ids = np.concatenate([ids[~bits], ids[bits]])
        return cls(planes, len(ids))

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given positions."""
        at = np.array(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane.get(at), plane.rank1(at)
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def all(self) -> np.ndarray:
        """The whole sequence, undoing one stable partition for each plane."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bits = plane.bits()
            before = np.empty(self.n, kind)
            before[~bits] = ids[:zeros]
            before[bits] = ids[zeros:] | kind(1 << level)
            ids = before
        return ids

    def _node(self, value: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of a value before a position lie below the last plane."""
        first, end = 0, upto
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank1(np.array([first, end]))
            if value >> (len(self.planes) - 1 - level) & 1:
                first, end = zeros + int(ones[0]), zeros + int(ones[1])
            else:
                first, end = first - int(ones[0]), end - int(ones[1])
        return first, end

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of a value before a position, or in all."""
        if value >> len(self.planes):
            return 0
        first, end = self._node(value, self.n if upto is None else upto)
        return end - first

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value, or -1."""
        if value >> len(self.planes):
            return -1
        first, end = self._node(value, self.n)
        if k >= end - first:
            return -1
        at = first + k
        for level in range(len(self.planes)):
            plane, zeros = self.planes[-1 - level], self.zeros[-1 - level]
            at = plane.select(1, at - zeros) if value >> level & 1 else plane.select(0, at)
        return at


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A shard file: header, document table (deflated), then each plane with its counts, deflated where that helps."""
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    absent = np.array([d is None for d in doc_ids], bool)
    table = zlib.compress(ids.tobytes() + np.packbits(absent).tobytes() + np.asarray(sizes, "<u4").tobytes(), 1)
    parts = [MAGIC, struct.pack("<QIII", matrix.n, len(doc_ids), len(matrix.planes), len(table)), table]
    for plane in matrix.planes:
        raw = plane.packed.tobytes()
        # one-sided planes deflate well, even ones not at all; a prefix tells which
        small = zlib.compress(raw, 1) if len(zlib.compress(raw[:4096], 1)) < 0.8 * min(len(raw), 4096) else raw
        data = small if len(small) < len(raw) else raw
        parts += [struct.pack("<II", len(plane.blocks), len(data)), plane.blocks.tobytes(), data]
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and token counts of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    n, n_docs, levels, table_size = struct.unpack_from("<QIII", data, 8)
    at = 8 + struct.calcsize("<QIII")
    table = zlib.decompress(data[at : at + table_size])
    at += table_size
    ids = np.frombuffer(table, "<i8", n_docs)
    absent = np.unpackbits(np.frombuffer(table, np.uint8, -(-n_docs // 8), 8 * n_docs), count=n_docs).astype(bool)
    sizes = np.frombuffer(table, "<u4", n_docs, 8 * n_docs + -(-n_docs // 8)).astype(np.int64)
    planes = []
    for _ in range(levels):
        n_blocks, size = struct.unpack_from("<II", data, at)
        at += 8
        blocks = np.frombuffer(data, "<u4", n_blocks, at)
        at += 4 * n_blocks
        raw = data[at : at + size]
        at += size
        if size != -(-n // 8):
            raw = zlib.decompress(raw)
        planes.append(BitPlane(np.frombuffer(raw, np.uint8), n, blocks))
    return WaveletMatrix(planes, n), [None if gone else int(i) for i, gone in zip(ids, absent)], sizes
