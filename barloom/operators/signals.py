"""Predictions to target positions, and how often those change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import col, mean_when
from barloom.functions.ranks import quantiles
from barloom.functions.windows import KEYS, by_date

LONG, FLAT, SHORT = 1.0, 0.0, -1.0


def signal_of(
    prediction: str | Column, threshold: float | Column = 0.0, allow_short: bool = False
) -> Column:
    """Long above the threshold, short below its negative (only if allowed).

    A prediction on the threshold, or a missing one, means no position.
    """
    if not isinstance(threshold, Column):
        if threshold < 0:
            raise ValueError(f"threshold is a magnitude, not {threshold}")
        threshold = F.lit(float(threshold))
    p = col(prediction)
    signal = F.when(p > threshold, LONG)
    if allow_short:
        signal = signal.when(p < -threshold, SHORT)
    return signal.otherwise(FLAT)


def generate_signals(
    df: DataFrame,
    prediction: str = "prediction",
    threshold: float | Column = 0.0,
    allow_short: bool = False,
) -> DataFrame:
    return df.withColumn("signal", signal_of(prediction, threshold, allow_short))


def buy_and_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("signal", F.lit(LONG))


def grid(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once per parameter value: a generator, not a join."""
    points = F.array(*[F.lit(float(v)) for v in values])
    return df.withColumn(name, F.explode(points))


def signal_summary(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shares long/flat/short, exposure, number of switches, mean holding."""
    s = F.col("signal")
    before = F.coalesce(F.lag("signal").over(by_date(*keys)), F.lit(FLAT))
    changes, active = F.count_if("__switch"), F.count_if(s != FLAT)
    n = F.count(F.lit(1))
    return (
        df.withColumn("__switch", s != before)
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            (mean_when(s == LONG) * 100).alias("long_pct"),
            (mean_when(s == FLAT) * 100).alias("flat_pct"),
            (mean_when(s == SHORT) * 100).alias("short_pct"),
            (active / n * 100).alias("exposure_pct"),
            changes.alias("n_changes"),
            F.when(changes > 0, F.try_divide(active, changes))
            .otherwise(n.cast("double"))
            .alias("avg_holding_days"),
        )
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    allow_short: bool = False,
    keys: Sequence[str] = KEYS,
    prediction: str = "prediction",
) -> DataFrame:
    """The signal summary for each candidate threshold."""
    swept = grid(df, "threshold", thresholds)
    return signal_summary(
        generate_signals(swept, prediction, F.col("threshold"), allow_short),
        [*keys, "threshold"],
    )


def suggest_threshold(
    df: DataFrame,
    exposure_pct: float = 50.0,
    prediction: str = "prediction",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Threshold that would be exceeded on about ``exposure_pct`` of the rows."""
    share = min(max(exposure_pct, 0.0), 100.0) / 100.0
    if "symbol" not in keys:
        cuts = quantiles(df, prediction, [1.0 - share], keys, "cut")
        return cuts.select(*keys, F.greatest(F.col("cut")[0], F.lit(0.0)).alias("threshold"))
    cut = F.percentile(prediction, F.lit(1.0 - share))
    return df.groupBy(*keys).agg(
        F.greatest(cut, F.lit(0.0)).alias("threshold")
    )
