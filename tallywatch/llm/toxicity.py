"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import batches as B
from .graph import saved
from .samples import fold_of, labelled
from .settings import ready

BITS = 20
STEMS = (4, 5, 6, 7, 8)
REPEATS = (2, 4)
SIZE = 1 << BITS
#: Texts are rated and fitted in slices of so many bytes: all terms of a slice are held with their factors.
RATED_BYTES = 1 << 19


def _apart() -> np.ndarray:
    """Bytes between terms: all ASCII but letters and digits."""
    apart = np.zeros(256, bool)
    apart[:128] = [not chr(c).isalnum() for c in range(128)]
    return apart


_APART = _apart()


def _repeated(hashed: np.ndarray, times: int) -> np.ndarray:
    """The term that says a term occurs so many times."""
    return (B.mix64(hashed.astype(np.uint64) + (np.uint64(times) << np.uint64(BITS))) >> np.uint64(64 - BITS)).astype(np.int64)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text and the bounds of the texts.

    Terms are lower-case words, their beginnings of 4 to 8 bytes, and for each
    of these a term that says it occurs 2 times or more, and one for 4.
    """
    data, bounds = B.flat_bytes(column)
    data = B.lower_ascii(data)
    if len(data) > 1:
        # capitals of the Latin-1 block: second byte 80-9E (but for 97, a sign) after C3
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = np.where(second, data + np.uint8(32), data)
    starts, ends, rows = B.word_spans(data, bounds, _APART)
    n = len(rows) - 1
    word_row = np.repeat(np.arange(n), np.diff(rows))
    found = []
    for size in (0, *STEMS):
        stem = B.span_hashes(data, starts, np.minimum(ends, starts + size) if size else ends)
        found.append((B.mix64(stem + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.concatenate([word_row << BITS | f for f in found])
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    row = key >> BITS
    more = [row[times >= r] << BITS | _repeated(key[times >= r] & (SIZE - 1), r) for r in REPEATS]
    key = B.distinct(np.concatenate([key, *more]))
    return key & (SIZE - 1), np.searchsorted(key >> BITS, np.arange(n + 1))


def _by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; the values lie row after row."""
    sizes = np.diff(bounds)
    if not len(values):
        return np.zeros((len(sizes), *values.shape[1:]), np.float64)
    out = np.add.reduceat(values, np.minimum(bounds[:-1], len(values) - 1), axis=0)
    out[sizes == 0] = 0
    return out


@dataclass
class FactorizationMachine:
    """Score of a set of terms: bias, a weight for each, and for each pair of terms the product of their factors.

    Every hashed term that the sample has has both; others have the input 0.
    ``weights`` and ``factors`` are in units of the inputs: a term's input is its
    scale, made smaller alike for all terms of a text whose inputs are longer
    than ``radius`` together.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: np.ndarray
    pair_scale: np.ndarray
    radius: float
    known: np.ndarray

    def opened(self) -> FactorizationMachine:
        """The same with the place of each known term. Numbers become wide when they are used: every worker has this beside the model."""
        made = FactorizationMachine(self.bias, self.weights, self.factors, self.scale, self.pair_scale, self.radius, self.known)
        made.place = np.full(SIZE, -1, np.int32)
        made.place[self.known] = np.arange(len(self.known))
        return made

    def features(self, hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms, and the bounds of the texts among them."""
        found = self.place[hashed]
        keep = found >= 0
        return found[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

    def shares(self, hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much the inputs of each text are made smaller, for weights and for pairs."""
        return tuple(
            np.minimum(1, self.radius / np.sqrt(np.maximum(_by_row(s[hashed].astype(np.float64) ** 2, bounds), 1e-12)))
            for s in (self.scale, self.pair_scale)
        )

    def margins(self, hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        alone, paired = self.shares(hashed, bounds)
        x = self.factors[hashed].astype(np.float32)
        sums, squares = _by_row(x, bounds), _by_row((x * x).sum(1), bounds)
        return self.bias + alone * _by_row(self.weights[hashed].astype(np.float32), bounds) + paired**2 * ((sums * sums).sum(1) - squares) / 2

    def scores(self, hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.features(hashed, bounds)), -30, 30)))


def _logit(share: float) -> float:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return float(np.log(share / (1 - share)))


def blank(prior: float, factors: int = 8, radius: float = 3.0) -> FactorizationMachine:
    """A machine that knows the share of the class alone."""
    none = np.zeros(0, np.float16)
    return FactorizationMachine(_logit(prior), none, np.zeros((0, factors), np.float16), none, none, radius, np.zeros(0, np.int32))


def documents_with(hashed: np.ndarray, bounds: np.ndarray, weights: np.ndarray, most: int = 256) -> np.ndarray:
    """For each term the weights of the documents that have it, summed for ``most`` documents at a time: numpy widens what it counts."""
    out = np.zeros(SIZE)
    for at in range(0, len(weights), most):
        part = slice(at, at + most)
        own = bounds[at : at + most + 1]
        out += np.bincount(hashed[own[0] : own[-1]], np.repeat(weights[part], np.diff(own)), SIZE)
    return out


def scales(hashed: np.ndarray, bounds: np.ndarray, labels: np.ndarray, shrink: float, soft: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all terms, for weights and for pairs: how much a fit may lean on each.

    Both grow with the documents of the sample that have the term and vanish for
    terms all of them have. For weights the input is larger the more the term's
    share differs between the classes. For pairs it is not: a term that tells
    nothing alone may tell all beside another.
    """
    n, ones = len(labels), max(int(labels.sum()), 1)
    zeros = max(n - int(labels.sum()), 1)
    docs, in_one = documents_with(hashed, bounds, np.ones(n)), documents_with(hashed, bounds, labels)
    share = docs / n
    pairs = docs / (docs + shrink) * (1 - share)
    spread = np.maximum(share * (1 - share) * (1 / ones + 1 / zeros), 1e-12)
    evidence = (in_one / ones - (docs - in_one) / zeros) ** 2 / spread
    return (pairs * (floor + (1 - floor) * evidence / (evidence + soft))).astype(np.float32), pairs.astype(np.float32)


class _Adam:
    """Adam steps on the rows of a parameter that a batch touches."""

    def __init__(self, start: np.ndarray, rate: float, least: float):
        self.value, self.rate, self.least = start, rate, least
        self.first, self.second = np.zeros(start.shape, start.dtype), np.zeros(start.shape, start.dtype)

    def step(self, rows: np.ndarray, gradient: np.ndarray, n: int) -> None:
        first = 0.9 * self.first[rows] + 0.1 * gradient
        second = 0.99 * self.second[rows] + 0.01 * gradient * gradient
        self.first[rows], self.second[rows] = first, second
        self.value[rows] -= self.rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + self.least)


def fit(hashed: np.ndarray, bounds: np.ndarray, labels: np.ndarray, prior: float, factors: int = 8, alone: int = 16, together: int = 6,
        batch: int = 256, rate: float = 0.02, pair_rate: float = 0.1, shrink: float = 20.0, soft: float = 30.0, floor: float = 0.05,
        radius: float = 3.0, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fit on the logistic loss, then move the bias from the sample's class share to ``prior``.

    ``alone`` rounds fit the weights; ``together`` rounds more fit weights and
    factors, so pairs learn what single terms leave unexplained. A batch's step
    touches its own terms only. Factors take full steps only where their
    gradients are not small. Parameters of terms that the sample lacks are not
    held, and of the terms themselves one copy, in the order of the batches.
    """
    rng = np.random.default_rng(seed)
    scale, pair_scale = scales(hashed, bounds, labels, shrink, soft, floor)
    there = documents_with(hashed, bounds, np.ones(len(labels))) > 0
    present = np.flatnonzero(there).astype(np.int32)
    scale, pair_scale = scale[present], pair_scale[present]
    weights = _Adam(np.zeros(len(present), np.float32), rate, 1e-7)
    crossed = _Adam(_normal_rows(rng, there, factors), pair_rate, 5e-3)
    bias = _Adam(np.zeros(1, np.float32), rate, 1e-8)
    machine = FactorizationMachine(0.0, weights.value, crossed.value, scale, pair_scale, radius, present).opened()
    order = rng.permutation(len(labels))
    batches = [_Batch(machine, order[at : at + batch], hashed, bounds, labels) for at in range(0, len(order), batch)]
    place = machine.place
    del hashed
    B.give_back()
    n = 0
    for turn in range(alone + together):
        for k in rng.permutation(len(batches)):
            n += 1
            batches[k].step(weights, crossed if turn >= alone else None, bias, decay, n, place)
    batches.clear()
    known = np.flatnonzero(pair_scale > 0)
    kept = (weights.value * scale, crossed.value * pair_scale[:, None], scale, pair_scale)
    moved = float(bias.value[0]) + _logit(prior) - _logit(labels.mean())
    return FactorizationMachine(moved, *[k[known].astype(np.float16) for k in kept], radius, present[known])


def _normal_rows(rng: np.random.Generator, wanted: np.ndarray, factors: int, rows: int = 1 << 14) -> np.ndarray:
    """The wanted rows of first factors, drawn for all terms some rows at a time."""
    drawn = (rng.normal(0, 0.02, (len(part), factors)).astype(np.float32)[part] for part in np.split(wanted, range(rows, len(wanted), rows)))
    return np.concatenate(list(drawn))


class _Batch:
    """Documents fitted at once: their terms, and where each term occurs. All batches are held, so each in few bytes a term."""

    def __init__(self, machine: FactorizationMachine, rows: np.ndarray, hashed: np.ndarray, bounds: np.ndarray, labels: np.ndarray):
        sizes = bounds[rows + 1] - bounds[rows]
        self.machine = machine
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.own = machine.place[hashed[np.repeat(bounds[rows] - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])]]
        self.labels = labels[rows].astype(np.float32)
        self.alone, self.paired = (s.astype(np.float32) for s in machine.shares(self.own, self.bounds))
        self.paired *= self.paired
        by_term = np.argsort(self.own, kind="stable")
        self.row = np.repeat(np.arange(len(rows), dtype=np.min_scalar_type(len(rows) - 1)), sizes)[by_term]
        ordered = self.own[by_term]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        self.terms = ordered[first]
        self.term_bounds = np.append(first, len(ordered)).astype(np.int32)

    def step(self, weights: _Adam, factors: _Adam | None, bias: _Adam, decay: float, n: int, place: np.ndarray) -> None:
        scale, pair_scale = self.machine.scale[self.terms], self.machine.pair_scale[self.terms][:, None]
        w = weights.value[self.terms]
        place[self.terms] = np.arange(len(self.terms), dtype=np.int32)  # room for it is shared by all batches
        place = place[self.own]
        margin = bias.value[0] + self.alone * _by_row((w * scale)[place], self.bounds)
        if factors is not None:
            v = factors.value[self.terms]
            x = v * pair_scale
            sums = _by_row(x[place], self.bounds)
            margin = margin + self.paired * ((sums * sums).sum(1) - _by_row((x * x).sum(1)[place], self.bounds)) / 2
        slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - self.labels) / len(self.labels)).astype(np.float32)
        pull = _by_row((slope * self.alone)[self.row], self.term_bounds).astype(np.float32)
        weights.step(self.terms, pull * scale + decay * w, n)
        if factors is not None:
            slopes = slope * self.paired
            cross = _by_row((slopes[:, None] * sums).astype(np.float32)[self.row], self.term_bounds)
            cross = cross - _by_row(slopes[self.row], self.term_bounds)[:, None] * x
            factors.step(self.terms, (cross * pair_scale + decay * v).astype(np.float32), n)
        bias.step(np.zeros(1, np.int64), np.array([slope.sum()], np.float32), n)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; the list is emptied, and each part goes as it is copied."""
    whole, at = np.empty(sum(map(len, parts)), np.int32), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        whole[at : at + len(part)] = part
        at += len(part)
    return whole


_MODEL_COLUMNS = "bias double, weights binary, factors binary, scale binary, pair_scale binary, radius double, known binary"


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None,
          most_per_class: int = 4000, factors: int = 8, seed: int = 7) -> FactorizationMachine:
    """Fit on at most ``most_per_class`` labelled training documents of either class.

    Each of the 2^20 hashed terms that the sample has gets a weight and ``factors``
    factors; none is chosen beforehand. The sample is fitted in one task of an
    executor, which sends the driver the model, at most 28 MB in numbers of two bytes. Labels alone are counted over all rows, for the
    prior. Without labels of both classes every document gets the prior as its
    score, about 0 without any label.

    Labels that are null or neither 0 nor 1 are left out; a document labelled
    twice takes the larger label, one whose id repeats its least text. Documents
    without a doc_id are not trained on. Null and empty texts have no terms, very
    long ones are read whole. Columns other than doc_id, text and the label do
    not matter. The same rows give the same model.
    """
    ready(docs.sparkSession)
    training = F.lit(True) if training is None else training
    one = labels.where(F.col(label).isin(0, 1) & training).agg(F.avg(label)).first()
    prior = float(one[0] or 0.0)
    sample = saved(labelled(B.id_and_text(docs), labels, label, training, most_per_class), "sample")

    def learn(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sizes, classes = [], [], []
        for part in B.slices(parts, most=RATED_BYTES):
            hashed, bounds = terms(part.column("text"))
            found.append(hashed.astype(np.int32))
            sizes.append(np.diff(bounds))
            classes.append(np.asarray(part.column("label")))
        if not found or len(np.unique(np.concatenate(classes))) < 2:
            return
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        made = fit(_joined(found), bounds, np.concatenate(classes), prior, factors, seed=seed)
        B.give_back()
        arrays = [pa.array([a.tobytes()], pa.binary()) for a in (made.weights, made.factors, made.scale, made.pair_scale, made.known)]
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), *arrays[:4], pa.array([made.radius]), arrays[4]], names=_MODEL_NAMES)

    row = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, _MODEL_COLUMNS).first()
    if row is None:
        return blank(prior, factors)
    weights, crossed, scale, pair_scale = (np.frombuffer(row[n], np.float16) for n in _MODEL_NAMES[1:5])
    known = np.frombuffer(row.known, np.int32)
    return FactorizationMachine(row.bias, weights, crossed.reshape(len(known), -1), scale, pair_scale, row.radius, known)


_MODEL_NAMES = [c.split()[0] for c in _MODEL_COLUMNS.split(", ")]


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 at ``threshold`` or above) of every document, in one pass.

    Whole texts are read. A null or empty text has no terms and gets the score
    of the bias alone. Repeated rows are scored each, null ids are kept, and
    other columns are not read. The model's size does not depend on the input.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(machine)

    def rate(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for part in B.slices(parts, most=RATED_BYTES):
            scores = model.scores(*terms(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return B.id_and_text(docs).mapInArrow(B.lean(rate), "doc_id bigint, score double, predicted int")


def keep(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """Rows of docs, with all their columns, whose text scores below the threshold; nothing is joined or shuffled.

    A null or empty text has the score of the bias alone. Repeated rows and rows
    without a doc_id are judged each by its text. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def choose(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for part in B.slices(parts, most=RATED_BYTES):
            scores = model.scores(*terms(part.column("text").fill_null("")))
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(B.lean(choose), docs.schema)


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(fold_of(folds) == fold, F.lit(False))
