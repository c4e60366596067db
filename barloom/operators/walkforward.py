"""Walk-forward validation: refit per fold, predict the next block, stitch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.durable import checkpointed
from barloom.functions.windows import KEYS, by_date, linspace_edges
from barloom.operators.backtest import run_backtest
from barloom.operators.evaluate import REGRESSION, regression_metrics
from barloom.operators.gram import moments
from barloom.operators.linear import linear_importance, predict_linear, solve_groups
from barloom.operators.models import (
    DEFAULTS,
    feature_importance,
    fit_many,
    fit_model,
    predict,
)
from barloom.operators.signals import generate_signals
from barloom.operators.target import realised_returns


def check_folds(n_folds: int, mode: str, min_train: int) -> None:
    if n_folds < 1:
        raise ValueError("n_folds must be at least 1")
    if mode not in ("expanding", "rolling"):
        raise ValueError(f"mode must be expanding or rolling, not {mode!r}")
    if min_train < 1:
        raise ValueError("min_train must be at least 1")


def with_folds(
    df: DataFrame,
    n_folds: int = 5,
    mode: str = "expanding",
    min_train: int = 500,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``fold`` (the fold that tests this row, 0 for none) and ``trains``.

    ``trains`` lists the folds whose training set holds the row.  The edges are
    arithmetic on the row's position, so there is no fold table to join.
    Symbols without enough rows for every fold are left out; ``skipped`` lists
    them.
    """
    check_folds(n_folds, mode, min_train)
    numbered = df.withColumns(
        {
            "__pos": F.row_number().over(by_date(*keys)) - 1,
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    ).where(F.col("__n") - min_train >= n_folds)
    edges = linspace_edges(float(min_train), F.col("__n"), n_folds)
    pos = F.col("__pos")
    numbered = numbered.withColumn("__edges", edges).withColumn(
        "fold", F.size(F.filter("__edges", lambda e: e <= pos))
    )

    def in_training(i):
        start = F.element_at("__edges", i)
        oldest = F.lit(0) if mode == "expanding" else F.greatest(start - min_train, F.lit(0))
        filled = F.element_at("__edges", i + 1) > start
        return filled & (pos >= oldest) & (pos < start)

    every = F.array(*[F.lit(i) for i in range(1, n_folds + 1)])
    return numbered.withColumn("trains", F.filter(every, in_training)).drop(
        "__pos", "__n", "__edges"
    )


def skipped(
    df: DataFrame, n_folds: int = 5, min_train: int = 500, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Symbols too short for the folds, with their rows and the rows needed."""
    need = F.lit(min_train + n_folds).cast("bigint")
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("needed", need)
        .where(F.col("n_rows") < F.col("needed"))
    )


def with_date_folds(
    df: DataFrame, n_folds: int = 5, mode: str = "expanding", min_train: int = 500
) -> DataFrame:
    """Folds over the distinct dates of all symbols together.

    The date table holds one row per bar interval of the calendar: ten thousand
    for forty years of days, some hundred thousand for hours.  That bounds its
    single window partition; the optimiser decides how it is joined.
    """
    dates = df.select("date").distinct().withColumn("__panel", F.lit(0))
    folds = with_folds(dates, n_folds, mode, min_train, ["__panel"]).drop("__panel")
    return df.join(folds, "date")


def make_folds(
    df: DataFrame,
    n_folds: int = 5,
    mode: str = "expanding",
    min_train: int = 500,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Fold bounds and sizes per symbol."""
    rows = with_folds(df, n_folds, mode, min_train, keys).select(*keys, "date", "fold", "trains")
    return fold_bounds(rows, keys)


def fold_bounds(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One pass: each row counts for the folds it trains and the one it tests."""
    roles = F.concat(
        F.transform("trains", lambda i: F.struct(i.alias("fold"), F.lit(True).alias("train"))),
        F.when(
            F.col("fold") > 0,
            F.array(F.struct(F.col("fold").alias("fold"), F.lit(False).alias("train"))),
        ).otherwise(F.array().cast("array<struct<fold:int,train:boolean>>")),
    )
    used = rows.select(*keys, "date", F.explode(roles).alias("r")).select(*keys, "date", "r.*")
    train, test = F.when(F.col("train"), F.col("date")), F.when(~F.col("train"), F.col("date"))
    return used.groupBy(*keys, "fold").agg(
        F.min(train).alias("train_start"),
        F.max(train).alias("train_end"),
        F.min(test).alias("test_start"),
        F.max(test).alias("test_end"),
        F.count(train).alias("n_train"),
        F.count(test).alias("n_test"),
    )


def _fold_moments(rows: DataFrame, features: Sequence[str], mode: str, keys: Sequence[str]):
    """Training moments per (keys, fold)."""
    columns = [*features, "target"]
    if mode == "rolling":
        used = rows.withColumn("fold", F.explode("trains"))
        return moments(used, columns, [*keys, "fold"])
    # Expanding: a fold trains on every earlier block, so the moments of the
    # blocks are summed once and added up along the folds.
    blocks = moments(rows.withColumnRenamed("fold", "__block"), columns, [*keys, "__block"])
    along = (
        Window.partitionBy(*keys, "at")
        .orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocks.withColumn("total", F.sum("total").over(along))
        .where(F.col("__block") > 0)
        .withColumnRenamed("__block", "fold")
    )


def walk_forward_linear(
    data: DataFrame,
    features: Sequence[str],
    alpha: float | None = None,
    n_folds: int = 5,
    mode: str = "expanding",
    min_train: int = 500,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample rows with ``fold`` and ``prediction``, and the fitted models.

    Every symbol and fold is fitted in the same pass over the data.
    """
    # read twice: for the moments and for the rows that are tested
    rows = checkpointed(with_folds(data, n_folds, mode, min_train, keys))
    sums = _fold_moments(rows, features, mode, keys)
    fitted = solve_groups(sums, features, [*keys, "fold"], alpha)
    tested = rows.where(F.col("fold") > 0).drop("trains")
    return predict_linear(tested, fitted, features, [*keys, "fold"]), fitted


def walk_forward_pooled(
    data: DataFrame,
    features: Sequence[str],
    name: str = "boosted",
    params: Mapping[str, Any] | None = None,
    seed: int = 42,
    n_folds: int = 5,
    mode: str = "expanding",
    min_train: int = 500,
    parallel: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """The same for any Spark ML model: one fit per fold, pooled over symbols.

    Folds are cut on the dates of the whole panel, so no symbol trains a fold
    on days that lie after another symbol's test block.
    """
    # every fold reads it for its facts, its fit and its prediction
    rows = checkpointed(with_date_folds(data, n_folds, mode, min_train))
    jobs = {
        i: (
            lambda i=i: fit_model(
                rows.where(F.array_contains("trains", i)), features, name, params, seed
            )
        )
        for i in range(1, n_folds + 1)
    }
    models = fit_many(jobs, parallel)
    out, importance = None, None
    for i, model in models.items():
        part = predict(model, rows.where(F.col("fold") == i).drop("trains"))
        weight = feature_importance(model, data.sparkSession).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
        importance = weight if importance is None else importance.unionByName(weight)
    return out, importance


def walk_forward(
    data: DataFrame,
    features: Sequence[str],
    name: str = "ridge",
    params: Mapping[str, Any] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Stitched predictions and per-fold (fold, feature, importance) rows."""
    if name in ("linear", "ridge"):
        options.pop("seed", None)
        alpha = {**DEFAULTS[name], **(params or {})}.get("alpha") if name == "ridge" else None
        out, fitted = walk_forward_linear(data, features, alpha, **options)
        keys = [*options.get("keys", KEYS), "fold"]
        return out, linear_importance(fitted, features, keys)
    return walk_forward_pooled(data, features, name, params, **options)


def fold_table(
    predictions: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Bounds, sizes and regression metrics of every fold."""
    group = [*keys, "fold"]
    return bounds.join(regression_metrics(predictions, keys=group).drop("n"), group)


def overall_metrics(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return regression_metrics(predictions, keys=keys)


def stability(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, spread and range of each numeric fold column."""
    names = [c for c in ("n_train", "n_test", *REGRESSION) if c in table.columns and c != "n"]
    return (
        table.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
        .unpivot(list(keys), names, "metric", "value")
        .groupBy(*keys, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def average_importance(importance: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Importance averaged over folds."""
    group = [k for k in keys if k in importance.columns]
    return importance.groupBy(*group, "feature").agg(F.avg("importance").alias("importance"))


def walk_forward_backtest(
    predictions: DataFrame,
    threshold: float = 0.0,
    allow_short: bool = False,
    cost_bps: float = 5.0,
    slippage_bps: float = 2.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Backtest of the stitched predictions; returns restart on the covered rows."""
    rows = realised_returns(predictions, keys=keys)
    signalled = generate_signals(rows, "prediction", threshold, allow_short)
    return run_backtest(signalled, keys, cost_bps, slippage_bps)
