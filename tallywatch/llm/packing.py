"""Bounded-space online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import work_dir
from . import batches as B
from .token_ids import encoder

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACE_COLUMNS = "sequence_id bigint, offset bigint"
_MERGED = 1 << 62
#: Packing stands at the end of a pipeline, where executors are fullest; more pieces save little time.
MOST_PIECES = 300_000


class OpenWindows:
    """At most ``most`` open windows of ``size``; an item goes where it leaves the least room.

    ``put`` gives the number and offset of the window that takes an item that is
    no longer than its room, or None if no window has the room and none may be
    opened. ``close_fullest`` gives up the window with the least room.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self._rooms: list[tuple[int, int]] = []
        self._next = 0

    def put(self, length: int) -> tuple[int, int] | None:
        at = bisect_left(self._rooms, (length, -1))
        if at < len(self._rooms):
            room, number = self._rooms.pop(at)
        elif len(self._rooms) < self.most:
            room, number = self.size, self._next
            self._next += 1
        else:
            return None
        if room > length:
            insort(self._rooms, (room - length, number))
        return number, self.size - room

    def least_room(self) -> int:
        return self._rooms[0][0]

    def close_fullest(self) -> int:
        return self._rooms.pop(0)[1]

    def left(self) -> set[int]:
        return {number for _, number in self._rooms}


def pack(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, size: int = 1024, windows: int = 32, end_id: int = 0,
         least_cut: int = 8, merged_partitions: int = 64) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens; one row for each piece of a document.

    A document is its ids and then ``end_id``. Its full windows become sequences
    of their own. The rest is placed best-fit into one of ``windows`` open
    windows of the partition. When none has room the fullest is emitted, first
    topped up with the head of the rest if its gap is at least ``least_cut``.
    Windows still open at the end are merged, best-fit and uncut, over groups of
    ``merged_partitions`` partitions; a group holds at most ``windows`` times as
    many windows, however large the input is.

    Null and empty texts are one token, the end id. Repeated rows are packed
    each. A null doc_id is kept. Other columns are not read. An empty table
    gives no rows. The placed pieces are written to the shared folder once, so
    that closed and open windows come from one and the same run.
    """
    def place(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_partition(parts, vocabulary, size, windows, end_id, least_cut)

    spark = docs.sparkSession
    path = work_dir(spark, "packed")
    placed_columns = f"{PIECE_COLUMNS}, {PLACE_COLUMNS}, partition int, open boolean"
    B.id_and_text(docs).mapInArrow(place, placed_columns).write.parquet(path)
    placed = spark.read.schema(placed_columns).parquet(path)
    closed = placed.where(~F.col("open")).drop("partition", "open")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return _merge_windows(group, size, windows, merged_partitions)

    group = F.floor(F.col("partition") / merged_partitions).alias("group")
    merged = placed.where("open").groupBy(group).applyInPandas(merge, f"{PIECE_COLUMNS}, {PLACE_COLUMNS}")
    return closed.unionByName(merged)


def _pack_partition(parts, vocabulary, size, windows, end_id, least_cut):
    tokenizer = encoder(vocabulary, MOST_PIECES)
    partition = TaskContext.get().partitionId()
    first = partition << 32
    open_windows = OpenWindows(size, windows)
    full = 0
    waiting: dict[int, list[tuple]] = {}

    def batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))]
        columns += [pa.array([partition] * len(rows), pa.int32()), pa.array([is_open] * len(rows), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [*names, "partition", "open"])

    for part in B.slices(parts, most=1 << 20, using=vocabulary):
        done: list[tuple] = []
        ids, bounds = tokenizer.encode(part.column("text"))
        for doc_id, begin, end in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            own = np.append(ids[begin:end], end_id).astype("<u4")
            total = len(own)
            at = 0

            def piece(length: int) -> tuple:
                return doc_id, at, length, zlib.crc32(own[at : at + length].tobytes()), total

            while total - at >= size:
                # full windows are numbered with odd, packed ones with even numbers
                done.append((*piece(size), first + 2 * full + 1, 0))
                full += 1
                at += size
            while at < total:
                length = total - at
                spot = open_windows.put(length)
                if spot is None:
                    gap = open_windows.least_room()
                    if gap < least_cut:
                        done += waiting.pop(open_windows.close_fullest())
                        continue
                    length = gap
                    spot = open_windows.put(length)
                number, offset = spot
                rows = waiting.setdefault(number, [])
                rows.append((*piece(length), first + 2 * number, offset))
                at += length
                if offset + length == size:
                    done += waiting.pop(number)
        if done:
            yield batch(done, False)
    left = [row for rows in waiting.values() for row in rows]
    if left:
        yield batch(left, True)
    # an executor has more workers than tasks; those that wait would hold a vocabulary each
    del tokenizer
    B.let_go()
    B.give_back()


def _merge_windows(group: pd.DataFrame, size: int, windows: int, merged_partitions: int) -> pd.DataFrame:
    """Put partly filled windows together, the fullest first, without cutting any."""
    group = group.sort_values(["sequence_id", "offset"], kind="stable")
    filled = group.groupby("sequence_id")["length"].sum()
    order = filled.reset_index().sort_values(["length", "sequence_id"], ascending=[False, True])
    targets = OpenWindows(size, len(order))
    first = _MERGED + ((int(group["partition"].iloc[0]) // merged_partitions) << 32)
    moved = {}
    for sequence, length in zip(order["sequence_id"], order["length"]):
        number, offset = targets.put(int(length))
        moved[sequence] = (first + number, offset)
    group["offset"] += group["sequence_id"].map(lambda s: moved[s][1])
    group["sequence_id"] = group["sequence_id"].map(lambda s: moved[s][0])
    return group.drop(columns=["partition", "open"])
