"""Descriptive tables behind the exploratory views."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (
    TRADING_DAYS,
    mean_when,
    ratio,
    sample_kurtosis,
    sample_skew,
)
from barloom.functions.windows import KEYS, by_date, first_n, roll, running
from barloom.operators.models import MODELS


def with_returns(
    bars: DataFrame, price: str = "close", keys: Sequence[str] = KEYS
) -> DataFrame:
    return bars.withColumn("ret", ratio(price, F.lag(price).over(by_date(*keys))) - 1)


def return_statistics(df: DataFrame, r: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    x = F.col(r)
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        sample_skew(x).alias("skew"),
        sample_kurtosis(x).alias("kurtosis"),
        mean_when(x > 0).alias("up_share"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
    )


def return_histogram(
    df: DataFrame, r: str = "ret", bins: int = 80, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Equal-width density histogram per key; empty bins have a count of 0.

    A key whose values are all equal has them in the first bin, of width 0.
    """
    span = Window.partitionBy(*keys)
    x = F.col(r)
    ranged = df.where(x.isNotNull()).withColumns(
        {"__lo": F.min(x).over(span), "__hi": F.max(x).over(span)}
    )
    width = (F.col("__hi") - F.col("__lo")) / bins
    spot = F.least(F.floor(ratio(x - F.col("__lo"), width)), F.lit(bins - 1))
    found = (
        ranged.withColumn("bin", F.coalesce(spot, F.lit(0)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("k"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi"))
    )
    # one map per key: the counts of at most ``bins`` bins
    packed = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"),
        F.first("lo").alias("lo"), ((F.first("hi") - F.first("lo")) / bins).alias("width"), F.sum("k").alias("n"),
    )
    count = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("bigint"))
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "width",
        count.alias("count"), ratio(count, F.col("n") * F.col("width")).alias("density"),
    )


def normal_density(
    df: DataFrame, r: str = "ret", points: int = 300, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The normal curve fitted to each key, on an even grid of its range."""
    x = F.col(r)
    fit = df.groupBy(*keys).agg(
        F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    z = ratio(F.col("x") - F.col("mu"), "sd")
    height = ratio(F.exp(-0.5 * z * z), F.col("sd") * math.sqrt(2 * math.pi))
    return (
        fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
        .select(*keys, "i", "x", height.alias("density"))
    )


def rolling_volatility(
    df: DataFrame, r: str = "ret", windows: Sequence[int] = (20, 60), keys: Sequence[str] = KEYS
) -> DataFrame:
    w = by_date(*keys)
    root = math.sqrt(TRADING_DAYS)
    return df.withColumns(
        {f"volatility_{n}": roll(F.stddev_samp, r, n, w) * root for n in windows}
    )


def cumulative_return(df: DataFrame, r: str = "ret", keys: Sequence[str] = KEYS) -> DataFrame:
    grown = running(F.product, 1 + F.coalesce(F.col(r), F.lit(0.0)), by_date(*keys))
    return df.withColumn("cumulative_return", grown - 1)


def price_with_averages(
    bars: DataFrame,
    windows: Sequence[int] = (20, 50, 200),
    price: str = "close",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Moving averages of the price; all missing on a series shorter than one."""
    w = by_date(*keys)
    return bars.withColumns({f"sma_{n}": roll(F.avg, price, n, w) for n in windows})


def volume_view(bars: DataFrame, window: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    return bars.withColumns(
        {
            "volume_mean": roll(F.avg, "volume", window, by_date(*keys)),
            "rising": F.col("close") >= F.col("open"),
        }
    )


def last_rows(bars: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ``n`` rows per key."""
    return first_n(bars, n, keys, F.desc("date"))


def top_by_magnitude(
    df: DataFrame, value: str, n: int, keys: Sequence[str] = KEYS, tie: str = "feature"
) -> DataFrame:
    """The ``n`` largest values by size, whatever their sign."""
    return first_n(df, n, keys, F.abs(value).desc_nulls_last(), tie)


def best_models(comparison: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best Sharpe, best return and lowest error among the models of a table.

    Of models that tie, the first in the order of ``MODELS`` is named, then by name.
    """
    model = F.when(F.col("model") != "buy_and_hold", F.col("model"))
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    first = F.when(place > 0, place).otherwise(len(MODELS) + 1)

    def best(value: Column) -> Column:
        """The model of the least value."""
        known = model.isNotNull() & value.isNotNull()
        return F.min_by(model, F.when(known, F.struct(value, first, "model")))

    return comparison.groupBy(*keys).agg(
        best(-F.col("sharpe_ratio")).alias("best_sharpe"),
        best(-F.col("total_return")).alias("best_return"),
        best(F.col("rmse")).alias("lowest_rmse"),
    )


def fold_spread(
    table: DataFrame, metric: str = "directional_accuracy", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean of a fold metric and whether it ranges over more than 10 points."""
    spread = F.max(metric) - F.min(metric)
    return table.groupBy(*keys).agg(
        F.avg(metric).alias("mean"), spread.alias("spread"), (spread > 0.10).alias("unstable")
    )


def overfit_flag(metrics: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Train R2 against test R2; a drop over 0.15 is marked."""
    of = {s: F.max(F.when(F.col("split") == s, F.col("r2"))) for s in ("train", "test")}
    return metrics.groupBy(*keys).agg(
        of["train"].alias("train_r2"),
        of["test"].alias("test_r2"),
        F.coalesce(of["train"] - of["test"] > 0.15, F.lit(False)).alias("overfit"),
    )


def trade_markers(
    trades: DataFrame, bars: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Entries and exits that fall on a bar of the chart, with their price."""
    points = F.explode(
        F.array(
            F.struct(F.col("entry_date").alias("date"), F.lit("entry").alias("kind"), F.col("entry_price").alias("price")),
            F.struct(F.col("exit_date").alias("date"), F.lit("exit").alias("kind"), F.col("exit_price").alias("price")),
        )
    )
    marks = trades.select(*keys, "direction", points.alias("p")).select(*keys, "direction", "p.*")
    return marks.join(bars.select(*keys, "date"), [*keys, "date"], "left_semi")


def regime_pairs(breakdown: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strategy and benchmark return per regime, one row each."""
    return breakdown.select(
        *keys,
        "breakdown",
        "regime",
        F.col("strategy_total_return").alias("strategy"),
        F.col("benchmark_total_return").alias("benchmark"),
    ).unpivot([*keys, "breakdown", "regime"], ["strategy", "benchmark"], "series", "total_return")


def sweep_curve(sweep: DataFrame, x: str, y: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x, y) points of a sweep chart."""
    return sweep.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
