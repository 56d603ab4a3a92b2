"""Byte-pair merges as a deterministic transducer whose transitions carry token counts.

The merges of a word's prefix end in one last token, and that token is the only
one compatible with the encoding of what stands before it. So after each symbol
the machine needs to remember, for every start from which a token may still
grow, only its place in the trie of tokens, the token that ends at that start,
and how many tokens lie between. These memories are the states; a transition's
weight is the change of the token count. States and transitions are compiled
when first met and shared by everything that runs in the process. When the
table is full it starts anew, which costs time and changes no result.

A text is a string of symbols cut into chunks of equal length. A chunk with a
word end maps every state to the same last state; the maps of consecutive chunks
compose by a prefix scan, which gives each chunk its state on entry, and all
chunks then run side by side.
"""

from __future__ import annotations

import numpy as np

from . import batches as B

END = 256
START = 0
_BIAS = 128


class MergeTransducer:
    """pieces: symbols of each piece; merges: (left, right, whole) piece numbers in order of rank."""

    def __init__(self, pieces: list[tuple[int, ...]], merges: list[tuple[int, int, int]], most_states: int = 120_000):
        self._symbols = pieces
        self._rank = {(left, right): (rank, whole) for rank, (left, right, whole) in enumerate(merges)}
        self._single = {symbols[0]: piece for piece, symbols in enumerate(pieces) if len(symbols) == 1}
        self._children: dict[int, int] = {}
        self._piece_at = [-1]
        self._grows = [False]
        for piece, symbols in enumerate(pieces):
            node = 0
            for symbol in symbols:
                key = node * 512 + symbol
                child = self._children.get(key)
                if child is None:
                    child = self._children[key] = len(self._piece_at)
                    self._piece_at.append(-1)
                    self._grows.append(False)
                    self._grows[node] = True
                node = child
            self._piece_at[node] = piece
        self._own: dict[int, bool] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._most = most_states
        self._column = np.zeros(512, np.int64)
        self._columns: list[int] = [-1]
        self.resets = 0
        self._clear()

    def _clear(self) -> None:
        self._number = {((0, -1, 0),): START}
        self._memory = [((0, -1, 0),)]
        self._table = np.full((1024, max(64, 2 * len(self._columns))), -1, np.int32)
        self._blank()

    def _blank(self) -> None:
        """Column 0 stands for no symbol: it keeps the state and counts nothing."""
        self._table[:, 0] = (np.arange(len(self._table), dtype=np.int32) << 8) | _BIAS

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        """Pieces after merging, lowest rank first, leftmost among equals."""
        parts = [self._single[s] for s in symbols]
        while len(parts) > 1:
            best = min(((self._rank.get(pair, (1 << 60, 0)), i) for i, pair in enumerate(zip(parts, parts[1:]))))
            (rank, whole), i = best
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [whole]
        return parts

    def _allowed(self, before: int, piece: int) -> bool:
        own = self._own.get(piece)
        if own is None:
            own = self._own[piece] = self.merge(self._symbols[piece]) == [piece]
        if not own or before < 0:
            return own
        fits = self._fits.get((before, piece))
        if fits is None:
            both = self.merge(self._symbols[before] + self._symbols[piece])
            fits = self._fits[before, piece] = both == [before, piece]
        return fits

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count)"""
        found, live = None, []
        for node, before, count in self._memory[state]:
            child = self._children.get(node * 512 + symbol)
            if child is None:
                continue
            piece = self._piece_at[child]
            if found is None and piece >= 0 and self._allowed(before, piece):
                found = (piece, count + 1)
            if self._grows[child]:
                live.append((child, before, count))
        if found is None:
            raise ValueError(f"symbol {symbol} has no piece")
        piece, change = found
        if symbol >= END:
            return START, change
        memory = (*((node, before, count - change) for node, before, count in live), (0, piece, 0))
        number = self._number.get(memory)
        if number is None:
            number = self._number[memory] = len(self._memory)
            self._memory.append(memory)
            if number >= len(self._table):
                grown = np.full((2 * len(self._table), self._table.shape[1]), -1, np.int32)
                grown[:number] = self._table
                self._table = grown
                self._blank()
        return number, change

    def _columns_of(self, symbols: np.ndarray) -> np.ndarray:
        columns = self._column[symbols]
        if (columns == 0).any():
            for symbol in B.distinct(symbols[columns == 0]):
                self._column[symbol] = len(self._columns)
                self._columns.append(int(symbol))
            if len(self._columns) > self._table.shape[1]:
                grown = np.full((len(self._table), 2 * len(self._columns)), -1, np.int32)
                grown[:, : self._table.shape[1]] = self._table
                self._table = grown
            columns = self._column[symbols]
        return columns

    def _advance(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        cells = self._table[states, columns]
        missing = cells < 0
        if missing.any():
            wide = self._table.shape[1]
            for key in B.distinct(states[missing] * wide + columns[missing]):
                state, column = divmod(int(key), wide)
                follow, change = self._step(state, self._columns[column])
                self._table[state, column] = (follow << 8) | (change + _BIAS)
            cells = self._table[states, columns]
        return cells

    def weights(self, symbols: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Change of the token count at each symbol of a stream that ends with a word."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int16)
        if len(self._memory) > self._most:
            self.resets += 1
            self._clear()
        rows = -(-n // chunk)
        columns = np.zeros(rows * chunk, np.int64)
        columns[:n] = self._columns_of(symbols)
        columns = columns.reshape(rows, chunk)
        ends = np.zeros(rows * chunk, bool)
        ends[:n] = symbols >= END
        ends = ends.reshape(rows, chunk)
        closed = ends.any(1)
        head = np.where(closed, ends.argmax(1) + 1, chunk)
        inside = np.arange(chunk) < head[:, None]
        out = np.zeros((rows, chunk), np.int16)
        leave = self._run(np.ascontiguousarray(np.where(inside, 0, columns).T), np.zeros(rows, np.int64), out)
        # the scan: a closed chunk's map is constant, so what enters a chunk is known once the one before it is
        known = closed.copy()
        enter_known = np.concatenate([[True], known[:-1]])
        enter = np.concatenate([[START], leave[:-1]])
        heads = np.where(inside, columns, 0)
        todo = np.arange(rows)
        while len(todo):
            now = todo[enter_known[todo]]
            widest = int(head[now].max())
            found = np.zeros((len(now), chunk), np.int16)
            last = self._run(np.ascontiguousarray(heads[now, :widest].T), enter[now], found)
            out[now] += found
            todo = todo[~enter_known[todo]]
            open_now = now[~closed[now]]
            leave[open_now] = last[~closed[now]]
            after = open_now[open_now + 1 < rows] + 1
            enter[after] = leave[after - 1]
            enter_known[after] = True
        return out.ravel()[:n]

    def _run(self, columns: np.ndarray, states: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Run all chunks side by side; columns has one row for each step."""
        for step, column in enumerate(columns):
            cells = self._advance(states, column)
            states = (cells >> 8).astype(np.int64)
            out[:, step] = (cells & 255) - _BIAS
        return states
