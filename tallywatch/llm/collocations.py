"""Phrases whose words keep together: counts by direct-address tiles, scored at their weakest cut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import spread_join
from . import batches as B
from .graph import saved

#: Units (words, then phrases) with a rank of their own, the most frequent ones of a length.
HEAD = 1 << 16
#: Ranks along one side of a tile.
SIDE = 512
#: A tile with at least so many pairs in a buffer is counted in a dense array; others as sorted coordinates.
DENSE = SIDE * SIDE // 8
#: Pairs or words a task holds before it emits their counts.
BUFFER = 1 << 19
#: Bits of the field that tells which units are frequent: 16 for each, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_ROW_BITS = 8 * 4096
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAKS.copy()
_APART[[32, 9]] = True
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def joined_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of the units made of two others, one place apart."""
    with np.errstate(over="ignore"):
        return B.mix64(left * _ODD + B.mix64(right * _ODD2))


def slice_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Bytes, first and end byte of each word, number of its piece, the groups and the group of each word."""
    data, bounds = B.flat_bytes(part.column("text"))
    data = B.lower_ascii(data)
    starts, ends, rows = B.word_spans(data, bounds, _APART)
    row = np.repeat(np.arange(part.num_rows), np.diff(rows))
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])
    # rows never share a piece: their numbers are apart by one more each
    piece = breaks[starts] + row
    groups = part.column("kind").dictionary_encode()
    return data, starts, ends, piece, groups.dictionary.to_pylist(), np.asarray(groups.indices)[row]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: list[str], group: np.ndarray) -> np.ndarray:
    """64-bit ids of words, another for each group."""
    names = [g.encode() for g in groups]
    bounds = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
    salt = B.span_hashes(np.frombuffer(b"".join(names), np.uint8), bounds[:-1], bounds[1:])
    return joined_ids(B.span_hashes(data, starts, ends), salt[group])


def _count_words(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, kind, word and count, summed over slices until the buffer is full."""
    known: dict[int, list] = {}
    for part in B.slices(parts, most=2 << 20):
        data, starts, ends, _, groups, group = slice_words(part)
        ids, first, times = np.unique(word_ids(data, starts, ends, groups, group), return_index=True, return_counts=True)
        raw = data.tobytes()
        for unit, at, n in zip(ids.tolist(), first.tolist(), times.tolist()):
            entry = known.get(unit)
            if entry:
                entry[2] += n
            else:
                known[unit] = [groups[group[at]], raw[starts[at]:ends[at]].decode(), n]
        if len(known) > BUFFER // 4:
            yield _word_batch(known)
            known = {}
    if known:
        yield _word_batch(known)


def _word_batch(known: dict[int, list]) -> pa.RecordBatch:
    kinds, words, times = zip(*known.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.fromiter(known, np.uint64, len(known)).view(np.int64)), pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64())],
        names=["id", "kind", "phrase", "f"])


@dataclass
class Level:
    """What a task knows of the frequent units of one length: a bit field of all, and the ids of the head by rank."""

    field: np.ndarray
    head: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.head)
        self.sorted = self.head[self.order]

    def frequent(self, ids: np.ndarray) -> np.ndarray:
        """False for units that are surely rare."""
        at = ids & np.uint64(8 * len(self.field) - 1)
        return (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """Rank of each unit, -1 for those beyond the head."""
        if not len(self.sorted):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
        return np.where(self.sorted[at] == ids, self.order[at], -1)


def tile_counts(left: np.ndarray, right: np.ndarray, level: Level) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Different pairs and how often each comes, by tiles of their ranks.

    Pairs of two ranked units fall into square tiles of ``SIDE`` ranks. Ranks go
    by frequency, so few tiles hold most pairs; these are counted in a dense
    array whose cells the ranks address directly. All other pairs are sorted as
    coordinates and counted by their runs.
    """
    a, b = level.ranks(left), level.ranks(right)
    ranked = (a >= 0) & (b >= 0)
    a, b = a[ranked], b[ranked]
    across = -(-len(level.head) // SIDE)
    tile = a // SIDE * across + b // SIDE
    times = np.bincount(tile, minlength=1)
    for t in np.flatnonzero(times >= DENSE).tolist():
        there = tile == t
        cells = np.bincount(a[there] % SIDE * SIDE + b[there] % SIDE, minlength=SIDE * SIDE)
        cell = np.flatnonzero(cells)
        yield level.head[t // across * SIDE + cell // SIDE], level.head[t % across * SIDE + cell % SIDE], cells[cell]
    sparse = times[tile] < DENSE
    if sparse.any():
        cell, n = np.unique(a[sparse] * len(level.head) + b[sparse], return_counts=True)
        yield level.head[cell // len(level.head)], level.head[cell % len(level.head)], n
    left, right = left[~ranked], right[~ranked]
    if len(left):
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        yield left[new], right[new], np.diff(np.append(new, len(left)))


def adjacent(part: pa.RecordBatch, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Units one place apart that may both be frequent; units have as many words as there are levels."""
    data, starts, ends, piece, groups, group = slice_words(part)
    ids = word_ids(data, starts, ends, groups, group)
    good = levels[0].frequent(ids)
    both = good[:-1] & good[1:] & (piece[:-1] == piece[1:])
    for level in levels[1:]:
        ids = joined_ids(ids[:-1], ids[1:])
        good = both & level.frequent(ids)
        both = good[:-1] & good[1:]
    return ids[:-1][both], ids[1:][both]


def _count_pairs(docs: DataFrame, levels: list[Level]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(level.field, level.head) for level in levels])

    def counted(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Level(*level) for level in shared.value]
        held, size = [], 0
        for part in B.slices(parts, most=2 << 20):
            pair = adjacent(part, known)
            held.append(pair)
            size += len(pair[0])
            if size >= BUFFER:
                yield from _pair_batches(held, known[-1])
                held, size = [], 0
        yield from _pair_batches(held, known[-1])

    rows = docs.mapInArrow(counted, "a bigint, b bigint, f bigint")
    return rows.groupBy("a", "b").agg(F.sum("f").alias("f"))


def _pair_batches(held: list[tuple[np.ndarray, np.ndarray]], level: Level) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    left, right = (np.concatenate([pair[side] for pair in held]) for side in (0, 1))
    for a, b, n in tile_counts(left, right, level):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64))], names=["a", "b", "f"])


def level_of(units: DataFrame, head: int = HEAD) -> Level | None:
    """Ranks and bit field of frequent units (id, f); None where there are none.

    At most ``head`` ids and a field of at most 32 MB reach the driver. Units
    beyond the head are kept by their ids; a fuller field lets more rare units
    through, which their counts then drop.
    """
    n, bits = units.count(), LEAST_BITS
    if not n:
        return None
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    field = np.zeros(bits // 8, np.uint8)
    place = F.col("id").bitwiseAND(F.lit(bits - 1))
    rows = units.select(place.alias("place")).groupBy(F.floor(F.col("place") / _ROW_BITS).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place") % _ROW_BITS).alias("bits"))
    for row in rows.toLocalIterator():
        there = field[row.block * 4096 : (row.block + 1) * 4096]
        there[:] = np.frombuffer(row.bits, np.uint8)[: len(there)]
    top = units.select("id", "f").orderBy(F.desc("f"), "id").limit(head).collect()
    return Level(field, np.array([r.id for r in top], np.int64).view(np.uint64))


def _longer(pairs: DataFrame, units: DataFrame, new_id: Column) -> DataFrame:
    """Units one word longer: text, counts of their beginnings and ends, and the phrases inside them."""
    inner = lambda side: F.when(F.col(f"{side}_words") > 1, F.array(side)).otherwise(F.array().cast("array<bigint>"))
    left = units.select(F.col("id").alias("a"), "kind", "phrase", "heads", F.col("inside").alias("a_inside"), F.col("words").alias("a_words"))
    right = units.select(F.col("id").alias("b"), "last", "tails", F.col("inside").alias("b_inside"), F.col("words").alias("b_words"))
    both = spread_join(spread_join(pairs, left, ["a"], "inner"), right, ["b"], "inner")
    return both.select(
        new_id.alias("id"), "kind", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", (F.col("a_words") + 1).alias("words"),
        F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        F.array_distinct(F.concat("a_inside", "b_inside", inner("a"), inner("b"))).alias("inside"),
    )


def _with_ids(pairs: DataFrame) -> DataFrame:
    """Pairs with the id of the unit they make, computed as the tasks do."""
    def named(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = (np.asarray(part.column(c)).view(np.uint64) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(joined_ids(a, b).view(np.int64))], names=[*part.schema.names, "id"])

    return pairs.mapInArrow(named, "a bigint, b bigint, f bigint, id bigint")


def phrase_counts(docs: DataFrame, group: str = "lang", least: int = 30, most_words: int = 4, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Frequent words and phrases of each group, and all word occurrences of each group (kind, n).

    The first has kind, phrase, words, f, heads and tails (counts of its first
    and of its last 1, 2, ... words), id, inside (ids of the phrases in it).
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("kind"))
    words = rows.mapInArrow(_count_words, "id bigint, kind string, phrase string, f bigint")
    words = saved(words.groupBy("id", "kind", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = saved(words.groupBy("kind").agg(F.sum("f").alias("n")), "word-totals")
    units = words.where(F.col("f") >= least).select(
        "id", "kind", "phrase", F.col("phrase").alias("last"), "f", F.lit(1).alias("words"), F.array("f").alias("heads"),
        F.array("f").alias("tails"), F.array().cast("array<bigint>").alias("inside"))
    found, levels = [saved(units, "units")], []
    while len(found) < most_words:
        level = level_of(found[-1], head)
        if level is None:
            break
        levels.append(level)
        pairs = saved(_with_ids(_count_pairs(rows, levels).where(F.col("f") >= least)), "pairs")
        found.append(saved(_longer(pairs.select("a", "b", "f", F.col("id").alias("new")), found[-1], F.col("new")), "units"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def collocations(
    docs: DataFrame, group: str = "lang", least: int = 30, most_words: int = 4, cover: int = 80, top: int = 2000, head: int = HEAD
) -> DataFrame:
    """The ``top`` phrases of each group by how well they hold together where they are weakest.

    Result: the group's column, rank from 1, phrase, a (its occurrences), l and r
    (those of the two parts of the cut that counts), n (all words of the group),
    score; numbers long. Texts are lower-cased in A-Z and split at ``.,;:!?`` and
    line ends into pieces and those at spaces and tabs into words. Phrases are 2
    to ``most_words`` words in a piece with ``least`` occurrences or more, at
    overlaps too. A cut scores floor(2000000 a / (l + r)); the lowest counts,
    ties go to the earliest. A phrase inside a longer one with ``cover`` percent
    of its occurrences or more is dropped. Order: score and a descending, phrase
    by its bytes.

    Method: words are ranked by frequency. Pairs of neighbours are counted in
    tiles of ranks, dense ones in arrays addressed by the ranks, sparse ones as
    sorted coordinates, and summed in Spark. Frequent pairs are ranked again and
    are the units of the next round: two units one place apart make a phrase one
    word longer. Words and pairs that are rare never enter a longer count. Units
    are 64-bit hashes of group and words, pairs are counted by both. What tasks
    share is bounded: ``head`` ranks and a 32 MB field a round.

    Null texts are empty; a null group is ``und``. Repeated rows count each time;
    doc_id is not read, so null or repeated ids do not matter, nor do other
    columns. A very long text is counted whole. An empty table gives no row.
    """
    units, totals = phrase_counts(docs, group, least, most_words, head)
    phrases = units.where("words > 1")
    exact = lambda c: c.cast("decimal(20,0)")
    covered = phrases.select("f", F.explode("inside").alias("id")).groupBy("id").agg(F.max("f").alias("longest"))
    kept = phrases.join(covered, "id", "left").where(F.col("longest").isNull() | (exact(F.col("longest")) * 100 < exact(F.col("f")) * cover))
    score = lambda l, r: F.call_function("div", exact(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)"), exact(l) + exact(r))  # noqa: E731, E741
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("words") - k - 1).alias("r")))
    scored = F.transform(cuts, lambda c: F.struct(score(c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    flat = kept.select("kind", "phrase", F.col("f").alias("a"), F.array_min(scored).alias("cut")).select("kind", "phrase", "a", "cut.*")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = flat.withColumn("rank", place).where(F.col("rank") <= top)
    return first.join(totals, "kind").select(
        F.col("kind").alias(group), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
