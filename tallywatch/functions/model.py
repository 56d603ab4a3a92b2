"""User-supplied model scoring over the feature vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .risk import FEATURES, feature_vector, model_score, rule_score

Predict = Callable[[np.ndarray], np.ndarray]


def score_with(features: Column, load_model: Callable[[], Predict] | None = None) -> Column:
    """Score the nine features with a model, or with the rules when none is given.

    ``load_model`` runs once per task and returns a function from an (n, 9)
    matrix to n raw outputs; batches reach it over Arrow. It is marked
    non-deterministic so that no plan runs it twice; filter before scoring.
    """
    if load_model is None:
        return rule_score(features)
    width = len(FEATURES)

    @F.pandas_udf(T.DoubleType())
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load_model()
        for vectors in batches:
            matrix = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, width))
            yield pd.Series(np.asarray(run(matrix), dtype=np.float64).reshape(-1))

    return model_score(predict.asNondeterministic()(feature_vector(features)))
