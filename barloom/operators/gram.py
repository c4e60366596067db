"""Second-moment matrices per group: the only pass linear models need.

Each task reduces its rows to one upper-triangular moment vector per group and
Arrow batch; Spark then sums the vectors element-wise with map-side combine.
What is shuffled depends on the number of groups, not of rows, so a group that
holds most of the data costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, at, total): element ``at`` of the summed upper triangle of
    ``[1, columns]' [1, columns]`` over the rows of a group without missing values.
    """
    columns, keys = list(columns), list(keys)
    rows, cols = np.triu_indices(len(columns) + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby(keys, sort=False):
                x = np.ones((len(part), len(columns) + 1))
                x[:, 1:] = part[columns].to_numpy("float64")
                out = pd.DataFrame([group], columns=keys)
                out["sums"] = [(x.T @ x)[rows, cols]]
                yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "sums array<double>"])
    narrow = df.select(*keys, *columns).dropna(subset=columns)
    return (
        narrow.mapInPandas(partial, schema)
        .select(*keys, F.posexplode("sums").alias("at", "value"))
        .groupBy(*keys, "at")
        .agg(F.sum("value").alias("total"))
    )


def packed(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group holding its whole triangle (fixed length) in order."""
    return m.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "total"))), lambda e: e["total"]
        ).alias("sums")
    )


def unpack(sums: Sequence[float], size: int) -> np.ndarray:
    """Symmetric ``size + 1`` square matrix from its packed upper triangle."""
    full = np.zeros((size + 1, size + 1))
    full[np.triu_indices(size + 1)] = np.asarray(sums, dtype="float64")
    return full + np.triu(full, 1).T


def centred(full: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, column means and centred cross-products of a moment matrix."""
    n = full[0, 0]
    mean = full[0, 1:] / n
    return n, mean, full[1:, 1:] - n * np.outer(mean, mean)
