"""Quality by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import batches as B
from .samples import fold_of, labelled, unlabelled

SHAPES = 256
_CLASSES = 8


def _classes() -> np.ndarray:
    """0 white space, 1 lower case and non-ASCII, 2 capitals, 3 digits, 4 sentence marks, 5 signs, 6 brackets and quotes, 7 control"""
    kind = np.full(256, 1, np.uint8)
    kind[:32] = 7
    kind[127] = 7
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for code in range(33, 127):
        char = chr(code)
        kind[code] = (1 if char.islower() else 2 if char.isupper() else 3 if char.isdigit() else 4 if char in ".,;:!?"
                      else 6 if char in "()[]{}\"'`" else 5)
    return kind


_KIND = _classes()


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text: shares of byte classes, repetition, line and word measures, word shapes.

    All are shares or bounded logarithms, so that length alone says little. An
    empty text is all zeros.
    """
    data, bounds = B.flat_bytes(column)
    n = len(column)
    out = np.zeros((n, 20 + SHAPES), np.float32)
    if not len(data):
        return out
    size = np.maximum(np.diff(bounds), 1)
    row = np.repeat(np.arange(n), np.diff(bounds))
    kind = _KIND[data]
    shares = np.bincount(row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / size[:, None]
    out[:, :_CLASSES] = np.sqrt(shares)
    starts, ends, words = B.word_spans(data, bounds)
    count = np.maximum(np.diff(words), 1)
    has = np.diff(words) > 0
    if not len(starts):
        return out
    word_row = np.repeat(np.arange(n), np.diff(words))
    hashed = B.span_hashes(data, starts, ends)
    length = np.minimum(ends - starts, 40)
    mean = np.bincount(word_row, length, n) / count
    out[:, 8] = mean / 10
    out[:, 9] = np.sqrt(np.maximum(np.bincount(word_row, length**2, n) / count - mean**2, 0)) / 10
    _, distinct = B.distinct_per_row(hashed, words)
    out[:, 10] = np.where(has, np.diff(distinct) / count, 0)
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (word_row[1:] == word_row[:-1])
    out[:, 11] = np.sqrt(np.bincount(word_row, same, n) / count)
    for place, run in ((12, 2), (13, 5)):
        runs, runs_bounds = B.shingle_hashes(hashed, words, run)
        _, apart = B.distinct_per_row(runs, runs_bounds)
        total = np.maximum(np.diff(runs_bounds), 1)
        out[:, place] = np.sqrt(np.where(has, 1 - np.diff(apart) / total, 0))
    breaks = np.zeros(256, bool)
    breaks[10] = True
    line_starts, line_ends, lines = B.word_spans(data, bounds, breaks)
    _, line_distinct = B.distinct_per_row(B.span_hashes(data, line_starts, line_ends), lines)
    n_lines = np.maximum(np.diff(lines), 1)
    out[:, 14] = np.sqrt(1 - np.diff(line_distinct) / n_lines) * (np.diff(lines) > 0)
    out[:, 15] = np.log1p(count / n_lines) / 6
    out[:, 16] = np.log1p(count) / 10
    capital = _KIND[data[starts]] == 2
    out[:, 17] = np.bincount(word_row, capital, n) / count
    out[:, 18] = np.sqrt(np.bincount(word_row, (ends - starts) == 1, n) / count)
    out[:, 19] = has
    # shape of a word: its byte classes with runs collapsed, marks kept as they are
    sign = np.where((kind == 1) | (kind == 2) | (kind == 3), kind, data)
    fresh = np.ones(len(data), bool)
    fresh[1:] = sign[1:] != sign[:-1]
    fresh[starts] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    shape = B.span_hashes(sign[fresh].astype(np.uint8), kept[starts], kept[ends]) >> np.uint64(56)
    share = np.bincount(word_row * SHAPES + shape.astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, 20:] = np.sqrt(share / count[:, None])
    # what has no words has no measures of words, whatever stands beside it in the batch
    out[~has, _CLASSES:] = 0
    return out


@dataclass
class PuClassifier:
    """A linear scorer on standardised features with a calibrated logistic output."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.shift, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled_: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03,
           decay: float = 1e-3, slack: float = 0.0) -> PuClassifier:
    """Minimise prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)).

    When the bracket falls below ``-slack`` the step climbs on it instead, as
    the non-negative estimator asks, so that the model cannot win by overfitting
    the unlabelled rows. Losses are logistic; Adam on all rows at once.
    """
    both = np.concatenate([positive, unlabelled_]).astype(np.float64)
    mean, spread = both.mean(0), np.maximum(both.std(0), 0.02)
    p = np.clip((positive - mean) / spread, -8, 8)
    u = np.clip((unlabelled_ - mean) / spread, -8, 8)
    weights, bias = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, steps + 1):
        on_p, on_u = p @ weights + bias, u @ weights + bias
        negative_risk = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
        pull_p, pull_u = _sigmoid(on_p), _sigmoid(on_u)
        g_negative = np.append(u.T @ pull_u / len(u) - prior * (p.T @ pull_p) / len(p), pull_u.mean() - prior * pull_p.mean())
        g_positive = prior * np.append(p.T @ (pull_p - 1) / len(p), (pull_p - 1).mean())
        gradient = -g_negative if negative_risk < -slack else g_positive + g_negative
        gradient[:-1] += decay * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return PuClassifier(mean, spread, weights, bias)


def calibrate(model: PuClassifier, x: np.ndarray, labels: np.ndarray, prior: float, steps: int = 60) -> PuClassifier:
    """Set slope and shift by Newton steps on labelled training rows, weighted to the prior, targets smoothed."""
    n_one, n_zero = int(labels.sum()), int((1 - labels).sum())
    if not n_one or not n_zero:
        return model
    m = model.margins(x)
    weight = np.where(labels == 1, prior / n_one, (1 - prior) / n_zero) * len(labels)
    target = np.where(labels == 1, (n_one + 1) / (n_one + 2), 1 / (n_zero + 2))
    beta = np.array([1.0, 0.0])
    design = np.stack([m, np.ones_like(m)], 1)
    for _ in range(steps):
        q = _sigmoid(design @ beta)
        gradient = design.T @ (weight * (q - target)) + 1e-3 * (beta - [1, 0])
        curve = design.T @ (design * (weight * q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    if beta[0] > 0:
        model.slope, model.shift = float(beta[0]), float(beta[1])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None,
          most_positive: int = 4000, most_unlabelled: int = 6000) -> PuClassifier:
    """Fit on trusted positives and unlabelled text, each sample bounded by its parameter.

    The class prior is the share of positives among all labelled training rows.
    Labelled negatives serve the calibration of the output only. Without any
    positive or any document every score is 0.5.
    """
    training = F.lit(True) if training is None else training
    rows = B.id_and_text(docs)
    prior = float(labels.where(F.col(label).isin(0, 1) & training).agg(F.avg(label)).first()[0] or 0.5)
    prior = min(max(prior, 0.02), 0.98)

    def measure(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts):
            x = features(part.column("text"))
            data = B.binary_array(x.view(np.uint8).ravel(), np.arange(len(x) + 1) * x.shape[1] * 4).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), data], ["doc_id", "label", "x"])

    known = labelled(rows, labels, label, training, most_positive)
    free = unlabelled(rows, training, most_unlabelled).withColumn("label", F.lit(-1))
    got = known.unionByName(free).mapInArrow(measure, "doc_id bigint, label int, x binary").orderBy("label", "doc_id").collect()
    width = 20 + SHAPES
    x = np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(-1, width)
    y = np.array([r.label for r in got], np.int64)
    positive, negative, u = x[y == 1], x[y == 0], x[y == -1]
    if not len(positive) or not len(u):
        return PuClassifier(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    model = fit_pu(positive, u, prior)
    both = np.concatenate([positive, negative])
    marks = np.concatenate([np.ones(len(positive), np.int64), np.zeros(len(negative), np.int64)])
    return calibrate(model, both, marks, prior)


def score(docs: DataFrame, model: PuClassifier, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 at ``threshold`` or above) of every document, in one pass.

    Whole texts are read; null and empty ones are scored by their zero features.
    Repeated rows are scored each, null ids are kept, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, most=2 << 20):
            scores = shared.value.scores(features(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return B.id_and_text(docs).mapInArrow(B.lean(rate), "doc_id bigint, score double, predicted int")


def keep(docs: DataFrame, model: PuClassifier, threshold: float = 0.7) -> DataFrame:
    """Rows of docs, with all their columns, whose text scores at or above the threshold; nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in B.slices(parts, most=2 << 20):
            scores = model.scores(features(part.column("text").fill_null("")))
            yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(B.lean(choose), docs.schema)


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(fold_of(folds) == fold, F.lit(False))
