"""Exact Jaccard join of documents on word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import spread_join
from . import batches as B
from .graph import components, release, saved, tidy
from .marks import hits, marks_of, with_place
from .segments import PROBE, signatures

#: 64-bit words of the sketch that bounds how far two sets differ.
SKETCH = 32
#: Sets with more elements have a finer sketch besides, since they fill the short one.
FULL = 64 * SKETCH // 3
#: Members of a signature's largest component that each of the others is tried with first.
SAMPLES = 3
_SET_COLUMNS = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint"


def _sets(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each document and the bounds of the documents."""
    data, bounds = B.flat_bytes(part.column("text"))
    data = B.lower_ascii(data)
    starts, ends, rows = B.word_spans(data, bounds)
    return B.distinct_per_row(*B.shingle_hashes(B.span_hashes(data, starts, ends), rows, words))


def _fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two signed numbers: equal for equal sets in any order."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(B.mix64(shingles))])
    other = np.concatenate([[np.uint64(0)], np.cumsum(B.mix64(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    of = lambda x: B.mix64(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64)
    return of(total), of(other)


def sets_with_keys(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, bounds, and both halves of the fingerprint of each document."""
    shingles, bounds = _sets(part, words)
    return shingles, bounds, *_fingerprints(shingles, bounds)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the shingle set and its 128-bit fingerprint (h1, h2)."""
    def measure(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, most=2 << 20):
            shingles, bounds = _sets(part, words)
            h1, h2 = _fingerprints(shingles, bounds)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2)],
                ["doc_id", "n_shingles", "h1", "h2"],
            )

    return B.id_and_text(docs).mapInArrow(B.lean(measure), _SET_COLUMNS)


def _stars(rows: DataFrame, partitions: int) -> DataFrame:
    """Pairs of each signature's nodes with one of them, its pivot: (sig, a, b); sig 0 where all pairs are given.

    ``rows`` are (sig, node, other). A row with ``other`` is a pair found before
    the shuffle already; it is dealt out by its node and passes through. Rows of
    a signature come sorted, so any number of them streams past in constant memory.
    """
    def link(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, pivot = None, None
        probes: list[int] = []
        for part in parts:
            sig, node, other = (np.asarray(part.column(c).fill_null(0)) for c in ("sig", "node", "other"))
            ready = np.asarray(part.column("other").is_valid())
            out = [(sig[ready], node[ready], other[ready])]
            sig, node = sig[~ready], node[~ready]
            kind = sig & 3
            plain = kind == 0
            s, n = sig[plain], node[plain]
            if len(s):
                if last_sig is not None and s[0] == last_sig:
                    s, n = np.insert(s, 0, last_sig), np.insert(n, 0, pivot)
                fresh = np.ones(len(s), bool)
                fresh[1:] = s[1:] != s[:-1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
                tied = ~fresh & (n != n[first])
                out.append((s[tied], n[first][tied], n[tied]))
                last_sig, pivot = s[-1], n[first[-1]]
            # small contents: probes come first and meet all others
            for value, one in zip(sig[~plain].tolist(), node[~plain].tolist()):
                if not probes or probes[0] >> 2 != value >> 2:
                    probes = [value]
                mates = probes[1:]
                if mates:
                    many = np.array([m for m in mates if m != one], np.int64)
                    out.append((np.zeros(len(many), np.int64), many, np.full(len(many), one)))
                if value & 3 == PROBE:
                    probes.append(one)
            columns = [np.concatenate(c) for c in zip(*out)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "a", "b"])

    deal = F.when(F.col("other").isNull(), F.shiftright("sig", 2)).otherwise(F.col("other"))
    return (
        rows.repartition(partitions, deal).sortWithinPartitions("sig", "node")
        .mapInArrow(B.lean(link), "sig bigint, a bigint, b bigint")
    )


def entries(sigs: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Rows (sig, node, other) of one slice; a signature met several times goes to the shuffle once."""
    sigs = sigs.view(np.int64)
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    keep = np.ones(len(sigs), bool)
    keep[1:] = (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])
    sigs, nodes = sigs[keep], nodes[keep]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = sigs[1:] != sigs[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(sigs)), 0))
    found = ~fresh & (sigs & 3 == 0)
    node = np.where(found, nodes[first], nodes)
    return pa.RecordBatch.from_arrays(
        [pa.array(sigs), pa.array(node), pa.array(np.where(found, nodes, 0), mask=~found)], ["sig", "node", "other"]
    )


def _document_entries(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Signature rows of all documents; equal sets of a task are entered once. A node is a set's h1."""
    def enter(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in B.slices(parts, most=2 << 20):
            shingles, bounds = _sets(part, words)
            h1, _ = _fingerprints(shingles, bounds)
            fresh = np.zeros(len(h1), bool)
            for row, value in enumerate(h1.tolist()):
                if bounds[row + 1] > bounds[row] and value not in seen:
                    seen.add(value)
                    fresh[row] = True
            items = np.repeat(fresh, np.diff(bounds))
            sizes = np.diff(bounds)[fresh]
            sigs, owner = signatures(shingles[items], np.concatenate([[0], np.cumsum(sizes)]), percent, 100)
            if len(sigs):
                yield entries(sigs, h1[fresh][owner])

    return B.id_and_text(docs).where("doc_id is not null").mapInArrow(B.lean(enter), "sig bigint, node bigint, other bigint")


def _sketches(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bit field of each set with the bit of every element set: fields differ in no more bits than sets in elements."""
    place = (B.mix64(shingles ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(64 - 11)).astype(np.int64)
    rows = len(bounds) - 1
    bits = np.zeros((rows, 64 * SKETCH), bool)
    bits[np.repeat(np.arange(rows), np.diff(bounds)), place] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


_SKETCH_COLUMNS = [f"s{n}" for n in range(SKETCH)]


def _fine_sketches(shingles: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The same kind of bit field with two bits or more an element, for sets that fill the short one; empty for others."""
    sizes = np.diff(bounds)
    power = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1
    n_bytes = np.where(sizes > FULL, 1 << np.maximum(power - 3, 0), 0)
    ends = np.concatenate([[0], np.cumsum(n_bytes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    large = n_bytes[row] > 0
    row = row[large]
    place = B.mix64(shingles[large] ^ np.uint64(0x3C6EF372FE94F82B)) >> (64 - power[row]).astype(np.uint64)
    bits = np.zeros(8 * int(ends[-1]), bool)
    bits[8 * ends[row] + place.astype(np.int64)] = True
    return B.binary_array(np.packbits(bits, bitorder="little"), ends).cast(pa.binary())


def _differing_bits(one: bytes, two: bytes) -> int:
    """Bits in which two fine sketches differ; the longer one is folded to the length of the other."""
    fields = [np.frombuffer(x, np.uint8) for x in sorted((one, two), key=len)]
    while len(fields[1]) > len(fields[0]):
        folded = np.unpackbits(fields[1], bitorder="little").reshape(-1, 2).max(1)
        fields[1] = np.packbits(folded, bitorder="little")
    return int(np.bitwise_count(fields[0] ^ fields[1]).sum())


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id, size, sorted shingles and sketches of the documents that have an id in ``ids``."""
    def collect(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(hits(parts, shared.value), most=2 << 20):
            shingles, bounds = _sets(part, words)
            h1, _ = _fingerprints(shingles, bounds)
            data = B.binary_array(shingles.view(np.uint8), bounds * 8).cast(pa.binary())
            sketch = _sketches(shingles, bounds)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(h1), pa.array(np.diff(bounds)), data, _fine_sketches(shingles, bounds),
                 *(pa.array(c) for c in sketch.T)],
                ["doc_id", "h1", "size", "shingles", "fine", *_SKETCH_COLUMNS],
            )

    shared = docs.sparkSession.sparkContext.broadcast(marks_of(ids))
    placed = with_place(B.id_and_text(docs), len(shared.value))
    columns = ", ".join(f"{c} bigint" for c in _SKETCH_COLUMNS)
    found = placed.mapInArrow(B.lean(collect), f"doc_id bigint, h1 bigint, size bigint, shingles binary, fine binary, {columns}")
    return found.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "h1"]).drop("h1")


def _sides(sets: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The named columns of the sets, once for each side of a pair."""
    return tuple(
        sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in ("a", "b")
    )


def _may_link(percent: int) -> Column:
    """False where sizes or sketches of sides a and b show that the sets differ too much."""
    smaller, larger = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH_COLUMNS), F.lit(0))
    allowed = (F.col("size_a") + F.col("size_b")) * (100 - percent)
    return (100 * smaller >= percent * larger) & (differ * (100 + percent) <= allowed)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough: by size and sketches first, then by the full sets."""
    def finer(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = np.asarray(part.column("size_a")) + np.asarray(part.column("size_b"))
            good = [
                not one or not two or _differing_bits(one, two) * (100 + percent) <= size * (100 - percent)
                for one, two, size in zip(part.column("fine_a").to_pylist(), part.column("fine_b").to_pylist(), sizes.tolist())
            ]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (one, first), (two, second) = (B.flat_bytes(part.column(c)) for c in ("shingles_a", "shingles_b"))
            one, two = one.view(np.uint64), two.view(np.uint64)
            good = []
            for a, b, c, d in zip(first[:-1] // 8, first[1:] // 8, second[:-1] // 8, second[1:] // 8):
                both = np.concatenate([one[a:b], two[c:d]])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = _sides(sets, "size", *_SKETCH_COLUMNS)
    near = pairs.join(left, "a").join(right, "b").where(_may_link(percent)).select("a", "b")
    left, right = _sides(sets, "size", "fine")
    near = saved(near.join(right, "b").join(left, "a").mapInArrow(B.lean(finer), "a bigint, b bigint"), "near")
    left, right = _sides(sets, "shingles")
    both = near.join(right, "b").join(left, "a")
    links = both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(B.lean(check), "a bigint, b bigint").distinct()
    links = saved(links, "links")
    release(near)
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of ``words``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a
    shorter text is one shingle). component_id is the smallest doc_id that can
    be reached by links.

    1. Documents with equal sets form a class, known by its smallest doc_id.
    2. Every distinct set enters its signatures (see ``segments``); sets that
       share one are tied to a pivot. A task ties its own sets first, so a hot
       signature sends one row per slice of a task to the shuffle.
    3. Tied pairs are verified on whole sets, and links joined to components.
    4. Where a signature's sets ended in different components, the sets outside
       the largest one are tried with a few of its members, which joins most.
    5. Where components still differ, they are compared with all others: sketches of 2048 bits differ
       in no more bits than the sets in elements, which rules out most pairs
       inside the join; the rest are verified.

    No pair that links is lost. Null, empty and blank texts have size 0, link with
    nothing and are their own component. Rows with a null doc_id get a null
    component and take no part. Repeated rows give a row each; rows of one
    doc_id are one document. Other columns are not read. Shingles are compared
    by 64-bit hashes.
    """
    described = saved(document_sets(docs, words), "sets")
    rows = _document_entries(docs, words, percent)
    return link_classes(docs, described, classes_of(described), rows, words, percent)


def classes_of(described: DataFrame) -> DataFrame:
    """Distinct sets (n_shingles, h1, h2) and the smallest doc_id that has them."""
    there = described.where("n_shingles > 0 and doc_id is not null")
    return saved(there.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id")), "classes")


def link_classes(docs: DataFrame, described: DataFrame, known: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of documents from the signature rows (sig, node, other) of their sets: steps 2 to 5 of the join."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def named(pairs: DataFrame, *more: str) -> DataFrame:
        a = known.select(F.col("h1").alias("a"), F.col("class_id").alias("class_a"))
        b = known.select(F.col("h1").alias("b"), F.col("class_id").alias("class_b"))
        return pairs.join(b, "b").join(a, "a").select(*more, F.col("class_a").alias("a"), F.col("class_b").alias("b"))

    ties = saved(named(_stars(rows, partitions), "sig"), "ties")
    fresh = saved(_ordered(ties), "pairs")
    ids = fresh.select(F.col("a").alias("doc_id")).unionByName(fresh.select(F.col("b").alias("doc_id"))).distinct()
    sets = saved(_sets_of(docs, ids, words), "shingles")
    tidy(docs.sparkSession)
    links = _verified(fresh, sets, percent)
    tidy(docs.sparkSession)
    found = components(links)
    tidy(docs.sparkSession)
    members = _apart(ties, found)
    placed = saved(_largest(members), "members")
    sampled = saved(_sampled(placed).join(fresh, ["a", "b"], "left_anti"), "pairs")
    release(ties, placed)
    gained = _verified(sampled, sets, percent)
    tidy(docs.sparkSession)
    if not gained.isEmpty():
        links = links.unionByName(gained)
        found = components(links)
    fresh = fresh.unionByName(sampled)
    tidy(docs.sparkSession)
    apart = _still_apart(members, found)
    rest = _across(apart, sets, percent)
    gained = _verified(rest.join(fresh, ["a", "b"], "left_anti"), sets, percent)
    if not gained.isEmpty():
        found = components(links.unionByName(gained))
    release(members, apart, sets, sampled, rest)
    tidy(docs.sparkSession)
    final = known.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "n_shingles", "h1", "h2", F.coalesce("component", "class_id").alias("component_id")
    )
    linked = described.join(final, ["n_shingles", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"))


def _apart(ties: DataFrame, found: DataFrame) -> DataFrame:
    """Members (sig, node, component) of the signatures whose members are not all in one component.

    A signature with a single tie has two members, a pair that was verified
    already. Ties are placed once, in files, and each gives both its ends.
    """
    one = found.select(F.col("node").alias("a"), F.col("component").alias("component_a"))
    two = found.select(F.col("node").alias("b"), F.col("component").alias("component_b"))
    placed = saved(ties.where("sig <> 0").join(one, "a", "left").join(two, "b", "left").select(
        "sig", "a", "b", F.coalesce("component_a", "a").alias("component_a"), F.coalesce("component_b", "b").alias("component_b")
    ), "placed")
    by_sig = placed.groupBy("sig").agg(F.max(F.col("component_a") != F.col("component_b")).alias("apart"), F.count("*").alias("n"))
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.col(f"component_{x}").alias("component")) for x in ("a", "b")])
    open_ = spread_join(placed, by_sig.where("apart and n > 1").select("sig"), ["sig"], "left_semi")
    members = saved(open_.select("sig", F.explode(ends).alias("end")).select("sig", "end.*").distinct(), "members")
    release(placed)
    return members


def _still_apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Those members, with their present components, whose signatures are not in one component yet: components only merge."""
    now = members.select("sig", "node").join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    now = saved(now, "members")
    ends = now.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    apart = saved(spread_join(now, ends.where("least <> most").select("sig"), ["sig"], "left_semi"), "members")
    release(now)
    return apart


def _largest(members: DataFrame) -> DataFrame:
    """Members with the largest component of their signature."""
    counted = members.groupBy("sig", "component").agg(F.count("*").alias("n"))
    largest = counted.groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    return spread_join(members, largest, ["sig"], "inner")


def _sampled(placed: DataFrame) -> DataFrame:
    """Pairs of each member outside its signature's largest component with a few of that component, chosen by hash.

    Near copies hang together in so many ways that these few pairs join nearly
    all of them; what they leave apart is compared in full afterwards.
    """
    main = placed.where("component = largest").groupBy("sig").agg(
        *[F.min_by("node", F.xxhash64("node", "sig", F.lit(n))).alias(f"m{n}") for n in range(SAMPLES)])
    other = placed.where("component <> largest").select("sig", "node").join(main, "sig")
    chosen = F.explode(F.array_distinct(F.array(*[f"m{n}" for n in range(SAMPLES)])))
    return _ordered(other.select(F.col("node").alias("a"), chosen.alias("b")))


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components that size and sketch do not rule out.

    Of a signature's members those outside its largest component are compared
    with all others. The comparison is part of the join, so that pairs ruled out
    are never made.
    """
    sketched = saved(_largest(members).join(sets.drop("shingles", "fine").withColumnRenamed("doc_id", "node"), "node"), "members")
    side = lambda x: sketched.select(
        "sig", (F.col("component") == F.col("largest")).alias(f"main_{x}"), F.col("node").alias(x),
        F.col("component").alias(f"component_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("size", *_SKETCH_COLUMNS)],
    )
    one, other = side("a").where("not main_a"), side("b")
    apart = (F.col("component_a") != F.col("component_b")) & (F.col("main_b") | (F.col("a") < F.col("b")))
    pairs = one.withColumnRenamed("sig", "sig_a").join(other, (F.col("sig_a") == F.col("sig")) & apart & _may_link(percent))
    rest = saved(_ordered(pairs.select("a", "b")), "pairs")
    release(sketched)
    return rest
