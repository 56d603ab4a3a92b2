"""MinHash fingerprints of documents and of their edited texts; near pairs by banded signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .jaccard import classes_of, document_sets, link_classes
from .graph import saved
from .ranges import split_points

PERMUTATIONS = 128
BANDS = 32
_LOWEST = -(1 << 63)


def _permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hashes (a * x + b) >> 32 over 64-bit words."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def minhash(shingles: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The smallest value of each hash over each row's shingles, one line for each row; all ones for a row without any."""
    out = np.full((len(bounds) - 1, permutations), 0xFFFFFFFF, np.uint32)
    full = np.diff(bounds) > 0
    if not full.any():
        return out
    starts = bounds[:-1][full]
    lowest = np.empty((permutations, len(starts)), np.uint32)
    work = np.empty(len(shingles), np.uint64)
    for k, (a, b) in enumerate(zip(*_permutations(permutations))):
        np.multiply(shingles, a, out=work)
        work += b
        # the high half decides, so minima of whole words have the minimal high half
        lowest[k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    out[full] = lowest.T
    return out


def _shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = B.flat_bytes(column)
    data = B.lower_ascii(data)
    starts, ends, rows = B.word_spans(data, bounds)
    return B.shingle_hashes(B.span_hashes(data, starts, ends), rows, words)


def fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """16 low bits of each minimum: the fingerprint that is stored."""
    return (minhash(*_shingles(column, words)) & np.uint32(0xFFFF)).astype(np.uint16)


def _hex(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints.astype(">u2")]


def with_edited(docs: DataFrame, words: int = 5, docs_per_range: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last n_chars // 4 code points replaced by the first
    as many (or all) of the next document in ascending doc_id, the last
    document taking the first one's. near_edited and near_next are the shares of
    equal minima with the edited text and with the next document.

    Documents are dealt once into ascending ranges of doc_id and stream past in
    order; the first document of each range, one row for each of a bounded
    number of ranges, is sent along to the range before it. Null and empty texts
    have no shingles: their fingerprint is all f, alike to each other only.
    Shorter texts than ``words`` words are one shingle. A null doc_id orders
    first. Rows that repeat a doc_id follow each other by text. Other columns
    are not read.
    """
    rows = B.id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    points = np.array(split_points(rows, "key", docs_per_range), np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, keys.to_numpy(), "right"), dtype="int32")

    ids = rows.select("key").withColumn("key_range", range_of("key"))
    first = dict(ids.groupBy("key_range").agg(F.min("key")).collect())
    filled = sorted(first)
    # the range that needs the first document of a range is the filled one before it
    before = {first[r]: filled[i - 1] for i, r in enumerate(filled)}
    guests = rows.where(F.col("key").isin(list(before))).groupBy("key").agg(
        F.min(F.struct("text", "doc_id")).alias("row")
    ).select("row.doc_id", "row.text", "key")

    @F.pandas_udf("int")
    def taker_of(keys: pd.Series) -> pd.Series:
        return keys.map(before).astype("int32")

    every = rows.withColumn("key_range", range_of("key")).withColumn("guest", F.lit(False)).unionByName(
        guests.withColumn("key_range", taker_of("key")).withColumn("guest", F.lit(True))
    )

    def edit(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for part in B.slices(parts):
            prints = fingerprints(part.column("text"), words)
            lines = list(zip(*(part.column(c).to_pylist() for c in ("key_range", "guest", "doc_id", "text")), prints))
            done: list[tuple] = []
            for line in lines:
                if held is not None and held[0] == line[0]:
                    done.append((*held[2:], line[3], line[4]))
                held = None if line[1] else line
            if not done:
                continue
            doc_ids, texts, own, nexts, next_prints = zip(*done)
            cut = [len(t) // 4 for t in texts]
            edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, nexts, cut)]
            own, next_prints = np.stack(own), np.stack(next_prints)
            edited_prints = fingerprints(pa.array(edited, pa.string()), words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(_hex(own)), pa.array(_hex(edited_prints)),
                    pa.array((own == edited_prints).mean(1)), pa.array((own == next_prints).mean(1)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return every.repartition(len(points) + 1, "key_range").sortWithinPartitions("key_range", "guest", "key", "text").select(
        "key_range", "guest", "doc_id", "text"
    ).mapInArrow(
        edit, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles and component_id of documents linked by banded MinHash signatures.

    Documents with the same minima throughout one of ``bands`` bands are
    candidates; every candidate tied to its band's pivot is verified on the
    whole sets. Unlike the exact join, a pair may be missed: at similarity s
    with r hashes in a band by chance (1 - s**r) ** bands. Nulls, empty texts,
    repeated rows and other columns count as for the exact join.
    """
    def enter(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .jaccard import entries, sets_with_keys

        for part in B.slices(parts):
            shingles, bounds, h1, _ = sets_with_keys(part, words)
            minima = minhash(shingles, bounds).reshape(len(h1), bands, -1)
            sigs = np.full((len(h1), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(minima.shape[2]):
                sigs = B.mix64(sigs + minima[:, :, k])
            full = np.diff(bounds) > 0
            if full.any():
                yield entries(sigs[full].ravel() & ~np.uint64(3), np.repeat(h1[full], bands))

    described = saved(document_sets(docs, words), "sets")
    rows = B.id_and_text(docs).where("doc_id is not null").mapInArrow(enter, "sig bigint, node bigint, other bigint")
    return link_classes(docs, described, classes_of(described), rows, words, percent)
