"""Corpora as wavelet shards in ascending document order, written and read by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import batches as B
from .ranges import split_points
from .token_counts import WORD_VOCABULARY
from .token_ids import encoder
from .wavelet import WaveletMatrix, from_bytes, to_bytes

SHARD_COLUMNS = "key_range int, shard int, first_token bigint, n_tokens bigint, n_docs bigint, file binary"


def write_shards(docs: DataFrame, path: str, vocabulary: str = WORD_VOCABULARY, end_id: int = 1, levels: int = 16,
                 docs_per_range: int = 4096, shard_tokens: int = 4 << 20) -> None:
    """Encode all documents and write them as wavelet shards to a folder that all executors share.

    Documents are dealt into ascending ranges of doc_id, ordered within each,
    and written as shards that close at ``shard_tokens``; a document is never
    divided, so one that is longer has a shard of its own. ``levels`` bits must
    hold every id. Only encoded ids are shuffled.

    A null or empty text is the end id alone. A null doc_id comes before all
    others. Repeated rows are all written, equal ids by their tokens. Other
    columns are not read. An empty table gives an empty folder.
    """
    rows = B.id_and_text(docs)
    points = np.array(split_points(rows, "doc_id", docs_per_range), np.int64)
    kind = np.uint16 if levels <= 16 else np.uint32

    def encode(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for part in B.slices(parts, most=8 << 20, using=vocabulary):
            ids, bounds = tokenizer.encode(part.column("text"))
            if len(ids) and int(ids.max()) >> levels:
                raise ValueError(f"an id needs more than {levels} bits")
            n = len(bounds) - 1
            whole = np.insert(ids, bounds[1:], end_id).astype(kind)
            cuts = (bounds + np.arange(n + 1)) * whole.itemsize
            keys = np.asarray(part.column("doc_id").fill_null(np.iinfo(np.int64).min))
            ranges = np.searchsorted(points, keys, "right").astype(np.int32)
            data = B.binary_array(whole.view(np.uint8), cuts).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ranges), data], ["doc_id", "key_range", "ids"])

    def build(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_range, shard, first = None, 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(h) for h in held]) // kind().itemsize
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(held), kind), levels)
            row = {"key_range": open_range, "shard": shard, "first_token": first, "n_tokens": tokens, "n_docs": len(names),
                   "file": to_bytes(matrix, names, sizes)}
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("key_range", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                ("n_docs", pa.int64()), ("file", pa.binary())]))

        for part in parts:
            for key_range, doc_id, ids in zip(*(part.column(c).to_pylist() for c in ("key_range", "doc_id", "ids"))):
                if held and (key_range != open_range or tokens >= shard_tokens):
                    yield close()
                    shard, first = (shard + 1, first + tokens) if key_range == open_range else (0, 0)
                    names, held, tokens = [], [], 0
                open_range = key_range
                names.append(doc_id)
                held.append(ids)
                tokens += len(ids) // kind().itemsize
        if held:
            yield close()

    encoded = rows.mapInArrow(encode, "doc_id bigint, key_range int, ids binary")
    ordered = encoded.repartition(len(points) + 1, "key_range").sortWithinPartitions("key_range", "doc_id", "ids")
    # the files are dense bits already
    ordered.mapInArrow(build, SHARD_COLUMNS).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard table: one row and one ``file`` for each shard."""
    return spark.read.schema(SHARD_COLUMNS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, ids_crc32, first_id (by access to its place).

    ``start`` counts the ids of all documents before it: those of earlier ranges,
    of which there are a bounded number, of earlier shards, and in the shard.
    """
    shards = read_shards(spark, path)
    totals = dict(shards.groupBy("key_range").agg(F.sum("n_tokens")).collect())
    starts, before = {}, 0
    for key_range in sorted(totals):
        starts[key_range] = before
        before += totals[key_range]

    def decode(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for key_range, first, file in zip(*(part.column(c).to_pylist() for c in ("key_range", "first_token", "file"))):
                matrix, doc_ids, sizes = from_bytes(file)
                ids = matrix.all().astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + first + starts[key_range]), pa.array(sizes),
                     pa.array(crcs, pa.int64()), pa.array(matrix.access(bounds[:-1]))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "first_id"],
                )

    return shards.select("key_range", "first_token", "file").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint"
    )
