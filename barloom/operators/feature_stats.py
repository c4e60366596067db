"""Diagnostics of the feature matrix, per symbol."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import FeatureSpec
from barloom.functions.columns import ratio, safe_corr, sample_kurtosis, sample_skew
from barloom.functions.ranks import quantiles
from barloom.functions.windows import KEYS, by_date
from barloom.operators.features import FEATURES, build_features, feature_names
from barloom.operators.gram import centred, moments, packed, unpack


def tall(
    df: DataFrame, names: Sequence[str] = FEATURES, keep: Sequence[str] = KEYS
) -> DataFrame:
    """(keep, feature, value) rows."""
    return df.unpivot(list(keep), list(names), "feature", "value")


def describe_features(
    df: DataFrame, names: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Count, moments, quartiles, missing share, skew and kurtosis per feature."""
    v, n = F.col("value"), F.count(F.lit(1))
    shares = (0.25, 0.5, 0.75)
    quartiles = F.percentile(v, F.array(*map(F.lit, shares))) if "symbol" in keys else F.lit(None).cast("array<double>")
    missing = F.count_if(v.isNull())
    long = tall(df, names, keys)
    out = (
        long.groupBy(*keys, "feature")
        .agg(
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            quartiles.alias("__q"),
            F.max(v).alias("max"),
            missing.alias("missing"),
            F.round(missing / n * 100, 2).alias("missing_pct"),
            sample_skew(v).alias("skew"),
            sample_kurtosis(v).alias("kurtosis"),
        )
    )
    if "symbol" not in keys:
        cuts = quantiles(long, "value", shares, [*keys, "feature"], "__q")
        out = out.drop("__q").join(cuts, [*keys, "feature"])
    return out.withColumns({q: F.col("__q")[i] for i, q in enumerate(("p25", "p50", "p75"))}).drop("__q")


def future_return_correlation(
    df: DataFrame,
    horizon: int = 1,
    names: Sequence[str] = FEATURES,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Correlation of each feature with the next return, strongest first."""
    future = ratio(F.lead("close", horizon).over(by_date(*keys)), "close") - 1
    strength = Window.partitionBy(*keys).orderBy(F.abs("corr").desc_nulls_last(), "feature")
    return (
        tall(df.withColumn("__future", future), names, [*keys, "__future"])
        .groupBy(*keys, "feature")
        .agg(safe_corr("value", "__future").alias("corr"))
        .withColumn("rank", F.row_number().over(strength))
    )


def leakage_report(
    df: DataFrame, horizon: int = 1, threshold: float = 0.3, **options
) -> DataFrame:
    """Correlation to 4 places; a feature beyond the threshold is suspicious."""
    found = future_return_correlation(df, horizon, **options)
    return found.withColumns(
        {
            "corr_with_future": F.round("corr", 4),
            "suspicious": F.coalesce(F.abs("corr") > threshold, F.lit(False)),
        }
    ).drop("corr")


def correlation_matrix(
    df: DataFrame, names: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, feature, other, corr) for every pair, from one moment pass.

    Constant features get NULL.  Rows with a missing feature are left out.
    """
    names, keys = list(names), list(keys)
    size = len(names)

    def finish(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                _, _, cross = centred(unpack(row["sums"], size))
                sd = np.sqrt(np.clip(np.diag(cross), 0, None))
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = cross / np.outer(sd, sd)
                corr[~np.isfinite(corr)] = np.nan
                out = pd.DataFrame(
                    {
                        "feature": np.repeat(names, size),
                        "other": np.tile(names, size),
                        "corr": corr.ravel(),
                    }
                )
                for k in reversed(keys):
                    out.insert(0, k, row[k])
                yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(
        [*(f"{k} {types[k]}" for k in keys), "feature string", "other string", "corr double"]
    )
    found = packed(moments(df, names, keys), keys).mapInPandas(finish, schema)
    return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def not_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    differs = F.abs(a - b) > atol + rtol * F.abs(b)
    return F.when(a.isNull() & b.isNull(), False).otherwise(F.coalesce(differs, F.lit(True)))


def rebuild_test(
    bars: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    share: float = 0.8,
    rtol: float = 1e-9,
    atol: float = 1e-12,
) -> DataFrame:
    """Rebuild the features on the first part of the history and compare.

    Per symbol: the last row of the shortened history against the same date of
    the full build.  ``offenders`` lists features that changed, i.e. looked
    ahead; it is empty for every feature of this library.
    """
    names = feature_names(spec)
    w = by_date("symbol")
    numbered = bars.withColumns(
        {
            "__pos": F.row_number().over(w),
            "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        }
    )
    head = numbered.where(F.col("__pos") <= F.floor(F.col("__n") * share)).drop("__pos", "__n")
    short = build_features(head, spec)
    last = F.max("date").over(Window.partitionBy("symbol"))
    cut = short.withColumn("__last", last).where(F.col("date") == F.col("__last"))
    full = build_features(bars, spec).select(
        "symbol", "date", *[F.col(c).alias(f"full_{c}") for c in names]
    )
    differing = F.array_compact(
        F.array(
            *[
                F.when(not_close(F.col(c), F.col(f"full_{c}"), rtol, atol), F.lit(c))
                for c in names
            ]
        )
    )
    return cut.join(full, ["symbol", "date"]).select(
        "symbol",
        F.col("date").alias("cut_date"),
        F.lit(len(names)).alias("compared"),
        differing.alias("offenders"),
    )
