"""Forward-return targets and the chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import StudySpec
from barloom.functions.columns import (
    TRADING_DAYS,
    mean_when,
    ratio,
    sample_kurtosis,
    sample_skew,
)
from barloom.functions.windows import KEYS, by_date
from barloom.operators.features import build_features

SPLITS = ("train", "valid", "test")


def forward_return(
    horizon: int = 1, price: str = "close", keys: Sequence[str] = KEYS
) -> Column:
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, not {horizon}")
    return ratio(F.lead(price, horizon).over(by_date(*keys)), price) - 1


def make_target(
    df: DataFrame,
    horizon: int = 1,
    kind: str = "regression",
    price: str = "close",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``target``; an unknown future stays missing for either kind."""
    if kind not in ("regression", "classification"):
        raise ValueError(f"unknown target kind {kind!r}")
    if price not in df.columns:
        raise KeyError(price)
    df = df.withColumn("target", forward_return(horizon, price, keys))
    if kind == "regression":
        return df
    up = F.when(F.col("target") > 0, 1.0).otherwise(0.0)
    return df.withColumn("target", F.when(F.col("target").isNotNull(), up))


def attach_target(
    df: DataFrame, horizon: int = 1, kind: str = "regression", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Target plus next-bar return; rows with an unknown future are dropped.

    Apply it after rows with missing features are gone: a return then spans
    the holes they left, which is what a model trained on these rows sees.
    """
    df = df.withColumn("return_1d_fwd", forward_return(1, keys=keys))
    return make_target(df, horizon, kind, keys=keys).dropna(
        subset=["target", "return_1d_fwd"]
    )


def chronological_split(df: DataFrame, train_end: str, valid_end: str) -> DataFrame:
    """Label rows train / valid / test; both boundary days belong to the left."""
    if train_end >= valid_end:
        raise ValueError(f"train_end {train_end} must precede valid_end {valid_end}")
    upto = {k: F.lit(v).cast("date") for k, v in (("train", train_end), ("valid", valid_end))}
    label = F.lit("test")
    for name in ("valid", "train"):
        label = F.when(F.col("date") <= upto[name], name).otherwise(label)
    return df.withColumn("split", label)


def split_summary(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys, "split").agg(
        n.alias("rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.round(n / TRADING_DAYS, 2).alias("years"),
    )


def split_faults(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Symbols that miss a part of the split, or whose parts overlap in time."""
    wide = split_summary(df, keys).groupBy(*keys).pivot("split", list(SPLITS)).agg(
        F.first("start").alias("start"), F.first("end").alias("end")
    )
    empty = [F.when(F.col(f"{s}_start").isNull(), F.lit(f"{s} is empty")) for s in SPLITS]
    overlap = [
        F.when(F.col(f"{a}_end") >= F.col(f"{b}_start"), F.lit(f"{a} overlaps {b}"))
        for a, b in zip(SPLITS, SPLITS[1:])
    ]
    return (
        wide.withColumn("fault", F.explode(F.array_compact(F.array(*empty, *overlap))))
        .select(*keys, "fault")
    )


def check_split(df: DataFrame, keys: Sequence[str] = KEYS) -> None:
    """Raise when a symbol misses a part or its parts overlap in time.

    One small aggregate decides for all symbols; only offenders reach the
    driver, and no more than a handful of those.
    """
    bad = split_faults(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"unusable split: {[r.asDict() for r in bad]}")
    if df.isEmpty():
        raise ValueError("cannot split an empty frame")


def split_xy(df: DataFrame, part: str, features: Sequence[str]) -> DataFrame:
    """Keys, features and target of one part."""
    return df.where(F.col("split") == part).select("symbol", "date", *features, "target")


def build_dataset(bars: DataFrame, spec: StudySpec) -> DataFrame:
    """Features, then target, then split; the order keeps each part contiguous."""
    featured = build_features(bars, spec.features)
    labelled = attach_target(featured, spec.horizon, spec.kind)
    return chronological_split(labelled, spec.train_end, spec.valid_end)


def realised_returns(
    df: DataFrame, price: str = "close", keys: Sequence[str] = ("symbol", "split")
) -> DataFrame:
    """Add ``asset_return``: the return realised on each row, 0 on the first.

    ``keys`` name the stretch that starts over, usually one split or the rows
    covered by walk-forward folds.
    """
    move = ratio(price, F.lag(price).over(by_date(*keys))) - 1
    return df.withColumn("asset_return", F.coalesce(move, F.lit(0.0)))


def class_balance(df: DataFrame, y: str = "target", keys: Sequence[str] = KEYS) -> DataFrame:
    up = mean_when(F.col(y) > 0)
    return df.groupBy(*keys).agg(
        (up * 100).alias("up_pct"),
        ((1 - up) * 100).alias("down_pct"),
        F.count(F.lit(1)).alias("n"),
    )


def target_summary(df: DataFrame, y: str = "target", keys: Sequence[str] = KEYS) -> DataFrame:
    t = F.col(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(t) * 100).alias("mean_pct"),
        (F.stddev_samp(t) * 100).alias("std_pct"),
        (F.min(t) * 100).alias("min_pct"),
        (F.max(t) * 100).alias("max_pct"),
        (mean_when(t > 0) * 100).alias("pct_positive"),
        sample_skew(t).alias("skew"),
        sample_kurtosis(t).alias("kurtosis"),
    )
