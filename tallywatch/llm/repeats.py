"""Removal of byte strings that occurred earlier in the corpus, by suffix arrays over anchored contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .anchors import GRAM, contexts
from .graph import saved
from .marks import marked, marks_of
from .samples import one_text_each
from .suffixes import suffix_array

WINDOW = 100
UNIT = 17
BATCH_CONTEXTS = 10_000
MOST_CONTEXTS = 20_000
_PLACE = "place bigint"


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start << 16 | windows << 8 | offset


def _context_rows(docs: DataFrame, window: int) -> DataFrame:
    """One row for each context: anchor, context, doc_id, place (start, windows, anchor offset), known.

    Of contexts equal within a slice only the first can be the first of all; the
    others are repeats already, marked ``known``.
    """
    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, most=1 << 20):
            data, bounds = B.flat_bytes(part.column("text"))
            c = contexts(data, bounds, window)
            if not len(c["row"]):
                continue
            doc = np.asarray(part.column("doc_id"))[c["row"]]
            anchor, context = c["anchor"].view(np.int64), c["context"].view(np.int64)
            order = np.lexsort((c["start"], doc, context))
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (context[a] == context[b]) & (anchor[a] == anchor[b]) & ((doc[a] != doc[b]) | (c["start"][a] != c["start"][b]))
            place = _pack(c["start"], c["windows"], c["offset"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[order]) for x in (anchor, context, doc, place)] + [pa.array(same)],
                ["anchor", "context", "doc_id", "place", "known"],
            )

    rows = B.id_and_text(docs).where("doc_id is not null")
    return rows.mapInArrow(B.lean(cut), f"anchor bigint, context bigint, doc_id bigint, {_PLACE}, known boolean")


def _sorted_out(rows: DataFrame) -> DataFrame:
    """(anchor, doc_id, place, repeat): contexts that occurred earlier, and firsts whose anchor has other contexts too.

    Rows of an anchor stream past in order, whatever their number. Known repeats
    are dealt out by document and pass through.
    """
    def sort_out(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, context, doc_id, place of the last first, and whether it was given out
        for part in parts:
            anchor, context, doc, place = (np.asarray(part.column(c)) for c in ("anchor", "context", "doc_id", "place"))
            known = np.asarray(part.column("known"))
            out = [(anchor[known], doc[known], place[known], np.ones(known.sum(), bool))]
            free = ~known
            anchor, context, doc, place = anchor[free], context[free], doc[free], place[free]
            if len(anchor):
                held = last is not None
                given = held and last[4]
                if held:
                    anchor, context, doc, place = (np.insert(x, 0, v) for x, v in zip((anchor, context, doc, place), last))
                new_anchor = np.ones(len(anchor), bool)
                new_anchor[1:] = anchor[1:] != anchor[:-1]
                first = new_anchor.copy()
                first[1:] |= context[1:] != context[:-1]
                at = np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0))
                # one document at one place, read twice, is no repeat of itself
                repeat = ~first & ((doc != doc[at]) | (place != place[at]))
                out.append((anchor[repeat], doc[repeat], place[repeat], np.ones(repeat.sum(), bool)))
                firsts = np.flatnonzero(first)
                own = anchor[firsts]
                shared = np.zeros(len(firsts), bool)
                shared[1:] |= own[1:] == own[:-1]
                shared[:-1] |= own[1:] == own[:-1]
                if held and given:
                    shared[0] = False
                end = firsts[-1]
                # a first is given out when a second context of its anchor is seen; the last one may still wait
                was_given = bool(shared[-1]) or (given and len(firsts) == 1)
                chosen = firsts[shared]
                out.append((anchor[chosen], doc[chosen], place[chosen], np.zeros(len(chosen), bool)))
                last = (anchor[end], context[end], doc[end], place[end], was_given)
            columns = [np.concatenate(c) for c in zip(*out)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "doc_id", "place", "repeat"])

    deal = F.when(F.col("known"), F.xxhash64("doc_id", "place")).otherwise(F.col("anchor"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(partitions, deal)
        .sortWithinPartitions("anchor", "context", F.col("known").desc(), "doc_id", "place")
        .mapInArrow(B.lean(sort_out), f"anchor bigint, doc_id bigint, {_PLACE}, repeat boolean")
    )


def _with_flanks(docs: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, at, least, most, left, right): bytes on both sides of each anchor, as far as its windows go.

    ``at`` is the anchor's place; windows start ``least`` to ``most`` bytes before it.
    """
    needed = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    texts = marked(B.id_and_text(docs), marks_of(firsts.select("doc_id").distinct()), True).dropDuplicates(["doc_id"])

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts):
            out: list[tuple] = []
            for doc_id, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                data = text.encode()
                for want in wanted:
                    start, windows, offset = want["place"] >> 16, want["place"] >> 8 & 255, want["place"] & 255
                    at, end = start + offset, start + windows - 1 + window
                    out.append((want["anchor"], doc_id, at, offset - windows + 1, offset, data[start:at], data[at + GRAM : end]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2)],
                    ["anchor", "doc_id", "at", "least", "most", "left", "right"],
                )

    return texts.join(needed, "doc_id").mapInArrow(
        B.lean(cut), "anchor bigint, doc_id bigint, at bigint, least int, most int, left binary, right binary"
    )


def _flank_matrix(column: pa.Array, width: int, reverse: bool) -> np.ndarray:
    """Flanks as rows of bytes, read away from the anchor and padded with zeros."""
    data, bounds = B.flat_bytes(column)
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), width), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(data)) - bounds[row]
    out[row, sizes[row] - 1 - step if reverse else step] = data
    return out


def _flank_order(group: np.ndarray, flanks: np.ndarray) -> np.ndarray:
    """Contexts ordered by group and flank: the order of the suffixes that begin with a group's symbol.

    Flanks are cut into units, units are named in byte order, and the suffix
    array of the joined string is built by linear grouping.
    """
    n, width = flanks.shape
    units = np.ascontiguousarray(flanks).view(f"V{UNIT}").ravel()
    kinds, names = np.unique(np.frombuffer(units.tobytes(), f"S{UNIT}"), return_inverse=True)
    string = np.empty((n, width // UNIT + 1), np.int64)
    string[:, 0] = len(kinds) + group
    string[:, 1:] = names.reshape(n, -1)
    order = suffix_array(string.ravel())
    return order[order % string.shape[1] == 0] // string.shape[1]


def _classes(group: np.ndarray, flanks: np.ndarray, depth: int) -> np.ndarray:
    """classes[i, d]: equal for contexts of one group whose flanks agree on the first d bytes."""
    order = _flank_order(group, flanks)
    ordered, g = flanks[order], group[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), flanks.shape[1])
    shared[g[1:] != g[:-1]] = -1
    breaks = shared[:, None] < np.arange(depth + 1)
    out = np.zeros((len(order), depth + 1), np.int64)
    out[order[1:]] = np.cumsum(breaks, 0)
    return out


def _repeated_windows(part: pa.Table, window: int) -> pa.RecordBatch:
    """Windows (doc_id, start, windows) of whole anchor groups that are not the first with their bytes."""
    order = np.lexsort(tuple(np.asarray(part.column(c)) for c in ("at", "doc_id", "anchor")))
    part = part.take(pa.array(order)).combine_chunks()
    anchor, doc, at, least, most = (np.asarray(part.column(c).combine_chunks()) for c in ("anchor", "doc_id", "at", "least", "most"))
    group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
    depth = window - GRAM
    width = -(-depth // UNIT) * UNIT
    left = _classes(group, _flank_matrix(part.column("left").combine_chunks(), width, True), depth)
    right = _classes(group, _flank_matrix(part.column("right").combine_chunks(), width, False), depth)
    count = (most - least + 1).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    # a row's windows from its first: the farthest before the anchor
    offset = most[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    n = len(count) + 1
    key = (left[row, offset] * n + right[row, depth - offset]) * (depth + 1) + offset
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    origin = row[first[inverse]]
    again = (doc[row] != doc[origin]) | (at[row] != at[origin])
    start = at[row] - offset
    begins = again.copy()
    begins[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
    ends = again.copy()
    ends[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row[b]]), pa.array(start[b]), pa.array(start[e] - start[b] + 1)], ["doc_id", "start", "windows"]
    )


def _by_suffix_arrays(flanked: DataFrame, window: int) -> DataFrame:
    """Repeated windows by suffix arrays over batches of whole anchor groups."""
    def compare(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= BATCH_CONTEXTS:
                whole = pa.Table.from_batches(held)
                anchor = np.asarray(whole.column("anchor").combine_chunks())
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield _repeated_windows(whole.slice(0, cut), window)
                    held, rows = whole.slice(cut).to_batches(), len(anchor) - cut
        if rows:
            yield _repeated_windows(pa.Table.from_batches(held), window)

    partitions = int(flanked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flanked.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(
        compare, "doc_id bigint, start bigint, windows bigint"
    )


def _by_fingerprints(flanked: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many contexts, whose groups no task should hold: windows grouped by 128-bit digests."""
    def digest(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for anchor, doc, at, least, most, left, right in zip(*(part.column(c).to_pylist() for c in (
                    "anchor", "doc_id", "at", "least", "most", "left", "right"))):
                for offset in range(least, most + 1):
                    bytes_ = anchor.to_bytes(8, "little", signed=True) + offset.to_bytes(2, "little")
                    bytes_ += left[len(left) - offset :] + right[: window - GRAM - offset]
                    out.append((hashlib.blake2b(bytes_, digest_size=16).digest(), doc, at - offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["digest", "doc_id", "start"])

    rows = flanked.mapInArrow(digest, "digest binary, doc_id bigint, start bigint")
    firsts = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    joined = rows.withColumn("mark", F.xxhash64("digest")).join(firsts.withColumn("mark", F.xxhash64("digest")), ["digest", "mark"])
    again = joined.where("doc_id <> first.doc_id or start <> first.start")
    return again.select("doc_id", "start", F.lit(1).cast("bigint").alias("windows"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, first, end): byte spans of each document covered by ``window``-byte strings that also start earlier.

    Earlier means in a document with a smaller doc_id or further left in the same.

    1. Every window has an anchor (see ``anchors``); equal windows have equal
       anchors at equal offsets. Windows with one anchor form a context.
    2. Contexts are sorted by anchor. A context seen earlier is repeated whole.
       Of the others only those whose anchor has several contexts can still
       share some windows: passage ends and places of edits.
    3. These are compared by suffix arrays of their bytes on both sides of the
       anchor, built by linear grouping; two windows are equal when the sides
       agree far enough. A window that is not the first of its class is repeated.

    Anchors with more than ``most_contexts`` different contexts go by digests of
    their windows, combined before the shuffle, with the same result. Spans may
    overlap or touch. Rows without doc_id take no part.
    """
    sorted_out = saved(_sorted_out(_context_rows(docs, window)), "contexts")
    whole = sorted_out.where("repeat").select(
        "doc_id", F.shiftright("place", 16).alias("start"), F.shiftright("place", 8).bitwiseAND(F.lit(255)).alias("windows")
    )
    firsts = sorted_out.where("not repeat")
    crowded = saved(firsts.groupBy("anchor").count().where(F.col("count") > most_contexts).select("anchor"), "crowded")
    parts = whole
    if firsts.isEmpty():
        flanked = None
    elif crowded.isEmpty():
        flanked = _with_flanks(docs, firsts, window)
    else:
        every = saved(_with_flanks(docs, firsts, window), "flanks")
        flanked = every.join(crowded, "anchor", "left_anti")
        parts = parts.unionByName(_by_fingerprints(every.join(crowded, "anchor", "left_semi"), window))
    if flanked is not None:
        parts = parts.unionByName(_by_suffix_arrays(flanked, window))
    return parts.select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1 + window).alias("end"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans and mark of every document after its repeated bytes are cut out.

    Strings are judged on the input, not on what is left; n_spans counts maximal
    runs. A null text counts as empty; texts shorter than ``window`` bytes stay
    whole, and so do rows with a null doc_id. Repeated rows of one doc_id are
    one document read twice: they do not repeat themselves, and each gives a row.
    Of texts that share a doc_id the least takes part, rows with another one stay
    whole. ``mark`` is xxhash64 of the text, to tell such rows apart.
    Other columns are not read. Only documents that lose something are shuffled.
    ``window`` is 64 to 112 bytes: contexts are told apart by hashes of up to 192.
    """
    if not 64 <= window <= 112:
        raise ValueError("window must be 64 to 112 bytes")
    rows, aside = one_text_each(B.id_and_text(docs))
    spans = saved(repeated_spans(rows, window, most_contexts), "spans")
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    field = marks_of(spans.select("doc_id").distinct())
    none = F.lit(None).cast("array<struct<first:bigint,end:bigint>>")
    touched = marked(rows, field, True).join(by_doc, "doc_id", "left")
    all_rows = touched.unionByName(marked(rows, field, False).withColumn("spans", none))
    if aside is not None:
        all_rows = all_rows.unionByName(aside.withColumn("spans", none))
    all_rows = all_rows.withColumn("mark", F.xxhash64("text"))

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts):
            out: list[tuple] = []
            for doc_id, text, own, mark in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans", "mark"))):
                data = text.encode()
                runs = _merged(own) if own else []
                kept, at = [], 0
                for first, end in runs:
                    kept.append(data[at:first])
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((doc_id, left, len(data), len(data) - len(left), len(runs), mark))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.binary()] + [pa.int64()] * 4)],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "mark"],
            )

    return all_rows.mapInArrow(B.lean(cut), "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, mark bigint")
