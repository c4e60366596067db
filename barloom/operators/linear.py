"""Least squares and ridge for every group of a panel in one pass.

The rows are reduced to moment matrices (see :mod:`barloom.operators.gram`);
each group then costs one small solve, whatever its number of rows.  Scaling
uses the group's own training moments, so nothing leaks from later rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.gram import centred, moments, packed, unpack


def solve(full: np.ndarray, alpha: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, coefficients and coefficients on standardised inputs.

    ``full`` is the moment matrix of ``[1, features, target]``.  Without
    ``alpha`` this is the minimum-norm least-squares solution, which also
    covers exactly dependent features.
    """
    n, mean, cross = centred(full)
    variance = np.clip(np.diag(cross)[:-1] / n, 0, None)
    # A feature whose spread is rounding noise counts as constant.
    scale_of = np.abs(mean[:-1]) * 1e-7
    sd = np.where(np.sqrt(variance) > scale_of, np.sqrt(variance), 1.0)
    xx = cross[:-1, :-1] / np.outer(sd, sd)
    xy = cross[:-1, -1] / sd
    if alpha is None:
        beta = np.linalg.pinv(xx, rcond=1e-11, hermitian=True) @ xy
    else:
        beta = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
    coef = beta / sd
    return float(mean[-1] - mean[:-1] @ coef), coef, beta


def solve_groups(
    sums: DataFrame, features: Sequence[str], keys: Sequence[str], alpha: float | None
) -> DataFrame:
    """(keys, n_train, intercept, coef, importance) from summed moments."""
    keys, size = list(keys), len(features) + 1

    def finish(batches):
        for batch in batches:
            out = batch[keys].copy()
            solved = [solve(m, alpha) for m in (unpack(s, size) for s in batch["sums"])]
            out["n_train"] = [int(s[0]) for s in batch["sums"]]
            out["intercept"] = [s[0] for s in solved]
            out["coef"] = [s[1] for s in solved]
            weights = [np.abs(s[2]) for s in solved]
            out["importance"] = [w / w.sum() if w.sum() > 0 else w for w in weights]
            yield out

    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(
        [
            *(f"{k} {types[k]}" for k in keys),
            "n_train bigint", "intercept double", "coef array<double>",
            "importance array<double>",
        ]
    )
    return packed(sums, keys).mapInPandas(finish, schema)


def fit_linear(
    train: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    alpha: float | None = None,
) -> DataFrame:
    """One linear (``alpha=None``) or ridge model per key."""
    sums = moments(train, [*features, "target"], keys)
    return solve_groups(sums, features, keys, alpha)


def linear_prediction(features: Sequence[str]) -> Column:
    """intercept + coef . features, inside the JVM."""
    products = F.zip_with(
        F.array(*[F.col(f) for f in features]), F.col("coef"), lambda x, b: x * b
    )
    return F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda a, v: a + v)


def predict_linear(
    df: DataFrame,
    fitted: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Add ``prediction`` from the model of each row's key."""
    models = fitted.select(*keys, "intercept", "coef")
    return (
        df.join(models, list(keys))
        .withColumn("prediction", linear_prediction(features))
        .drop("intercept", "coef")
    )


def linear_importance(
    fitted: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """(keys, feature, importance) rows."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("importance")))
    return fitted.select(*keys, pairs.alias("p")).select(
        *keys, F.col("p.feature").alias("feature"), F.col("p.importance").alias("importance")
    )
