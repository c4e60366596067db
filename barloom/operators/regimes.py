"""Market regimes and performance inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.windows import KEYS, by_date, roll
from barloom.operators.metrics import performance

#: Regime labels.
LOW, MEDIUM, HIGH = "low_vol", "medium_vol", "high_vol"
BEAR, BULL = "bear", "bull"

_CUTS = (1 / 3, 2 / 3)


def _vol_label(known: Column) -> Column:
    vol = F.col("vol")
    return F.when(
        known,
        F.when(vol > F.col("upper"), HIGH).when(vol <= F.col("lower"), LOW).otherwise(MEDIUM),
    )


def _earlier_below(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Add ``earlier`` and ``below``: rows before this one, and those with a smaller value.

    Rows of a key are cut into about sqrt(n) blocks twice, by time and by value
    (equal values share a block).  Whole blocks that lie earlier and lower come
    from a grid of running counts; the rest is counted inside one time block
    and inside one value block, so n rows cost n ** 1.5 at most and no row is
    compared with its whole history.
    """
    keys = list(keys)
    v, t = F.col(value), F.col("earlier")
    by_value = Window.partitionBy(*keys).orderBy(value)
    rows = df.where(v.isNotNull()).withColumns(
        {
            "earlier": F.row_number().over(by_date(*keys)) - 1,
            "__rank": F.rank().over(by_value) - 1,
            "__block": F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy(*keys)))),
        }
    )
    rows = rows.withColumns(
        {
            "__t": F.floor(t / F.col("__block")).cast("int"),
            "__v": F.floor(F.col("__rank") / F.col("__block")).cast("int"),
        }
    )
    cells = rows.groupBy(*keys, "__t", "__v").count()
    size = cells.groupBy(*keys).agg(F.max("__t").alias("__tn"), F.max("__v").alias("__vn"))
    grid = (
        size.withColumn("__t", F.explode(F.sequence(F.lit(0), "__tn")))
        .withColumn("__v", F.explode(F.sequence(F.lit(0), "__vn")))
        .drop("__tn", "__vn")
        .join(cells, [*keys, "__t", "__v"], "left")
    )
    ahead = Window.unboundedPreceding, -1
    over_time = Window.partitionBy(*keys, "__v").orderBy("__t").rowsBetween(*ahead)
    over_value = Window.partitionBy(*keys, "__t").orderBy("__v").rowsBetween(*ahead)
    grid = grid.withColumn("__g", F.sum("count").over(over_time)).select(
        *keys, "__t", "__v", F.coalesce(F.sum("__g").over(over_value), F.lit(0)).alias("__whole")
    )
    level = (
        rows.groupBy(*keys, "__v", "__t", v.alias("x")).count()
        .groupBy(*keys, "__v")
        .agg(F.collect_list(F.struct("__t", "x", "count")).alias("__level"))
    )
    span = (
        rows.groupBy(*keys, "__t").agg(F.collect_list(F.struct("earlier", v.alias("x"))).alias("__span"))
    )
    in_level = F.aggregate(
        F.filter("__level", lambda e: (e["__t"] < F.col("__t")) & (e["x"] < v)),
        F.lit(0).cast("bigint"),
        lambda a, e: a + e["count"],
    )
    in_span = F.size(F.filter("__span", lambda e: (e["earlier"] < t) & (e["x"] < v)))
    return (
        rows.join(grid, [*keys, "__t", "__v"])
        .join(level, [*keys, "__v"])
        .join(span, [*keys, "__t"])
        .withColumn("below", F.col("__whole") + in_level + in_span)
        .drop("__rank", "__block", "__t", "__v", "__whole", "__level", "__span")
    )


def _causal_label(df: DataFrame, keys: Sequence[str], min_periods: int) -> DataFrame:
    """Label each bar by the terciles of its own past, itself included.

    With ``t`` earlier values the terciles lie at positions t/3 and 2t/3 of the
    sorted past, so the number of smaller values decides on which side of the
    interpolated cut a value is.
    """
    counted = _earlier_below(df, "vol", keys)
    t, below = F.col("earlier"), F.col("below")
    label = F.when(
        t + 1 >= min_periods,
        F.when(below * 3 > 2 * t, HIGH).when(below * 3 <= t, LOW).otherwise(MEDIUM),
    )
    found = counted.select(*keys, "date", label.alias("vol_regime"))
    return df.join(found, [*keys, "date"], "left")


def volatility_regime(
    df: DataFrame,
    window: int = 20,
    causal: bool = False,
    price: str = "close",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``vol_regime`` from terciles of trailing volatility.

    The default terciles come from the whole sample and are meant for looking
    back on history only.  ``causal`` compares each bar with its own past.
    """
    w = by_date(*keys)
    df = df.withColumn("__r", ratio(price, F.lag(price).over(w)) - 1)
    df = df.withColumn("vol", roll(F.stddev_samp, "__r", window, w)).drop("__r")
    if causal:
        return _causal_label(df, keys, window * 3).drop("vol")
    cuts = F.percentile("vol", F.array(*[F.lit(q) for q in _CUTS]))
    df = df.withColumn("__cuts", cuts.over(Window.partitionBy(*keys))).withColumns(
        {"lower": F.col("__cuts")[0], "upper": F.col("__cuts")[1]}
    ).drop("__cuts")
    known = F.col("vol").isNotNull()
    return df.withColumn("vol_regime", _vol_label(known)).drop("vol", "lower", "upper")


def trend_regime(
    df: DataFrame, window: int = 200, price: str = "close", keys: Sequence[str] = KEYS
) -> DataFrame:
    mean = roll(F.avg, price, window, by_date(*keys))
    df = df.withColumn("__mean", mean)
    label = F.when(F.col(price) > F.col("__mean"), BULL).otherwise(BEAR)
    return df.withColumn("trend_regime", F.when(F.col("__mean").isNotNull(), label)).drop("__mean")


def label_regimes(
    df: DataFrame,
    price: str = "close",
    vol_window: int = 20,
    trend_window: int = 200,
    causal: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``vol_regime``, ``trend_regime`` and ``regime`` (both, or missing)."""
    df = volatility_regime(df, vol_window, causal, price, keys)
    df = trend_regime(df, trend_window, price, keys)
    return df.withColumn(
        "regime", F.concat(F.col("trend_regime"), F.lit("_"), F.col("vol_regime"))
    )


def performance_by_regime(
    df: DataFrame,
    labels: Sequence[tuple[str, str]] = (
        ("volatility", "vol_regime"),
        ("trend", "trend_regime"),
        ("combined", "regime"),
    ),
    strategy: str = "strategy_return",
    benchmark: str = "asset_return",
    min_days: int = 20,
    keys: Sequence[str] = KEYS,
    **options,
) -> DataFrame:
    """Strategy and benchmark scored separately inside each regime.

    ``labels`` pairs a breakdown name with its label column.  Rows of a regime
    are strung together, so equity restarts at 1 and runs over the seams.
    Regimes shorter than ``min_days`` are left out but still count in the
    denominator of ``pct_of_sample``.
    """
    tags = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("breakdown"), F.col(c).alias("regime"))
                for name, c in labels
            ]
        )
    )
    group = [*keys, "breakdown", "regime"]
    rows = (
        df.select(*keys, "date", strategy, benchmark, tags.alias("tag"))
        .select(*keys, "date", strategy, benchmark, "tag.*")
        .where(F.col("regime").isNotNull())
        .withColumns(
            {
                "__days": F.count(F.lit(1)).over(Window.partitionBy(*group)),
                "__all": F.count(F.lit(1)).over(Window.partitionBy(*keys, "breakdown")),
            }
        )
        .where(F.col("__days") >= min_days)
    )
    scored = performance(
        rows,
        {"strategy": strategy, "benchmark": benchmark},
        [*group, "__days", "__all"],
        **options,
    )
    picked = {
        "total_return": "total_return",
        "sharpe_ratio": "sharpe",
        "max_drawdown": "max_drawdown",
        "win_rate": "win_rate",
    }
    wide = scored.groupBy(*group, "__days", "__all").agg(
        *[
            F.max(F.when(F.col("series") == s, F.col(c))).alias(f"{s}_{short}")
            for c, short in picked.items()
            for s in ("strategy", "benchmark")
        ]
    )
    excess = F.col("strategy_total_return") - F.col("benchmark_total_return")
    return wide.select(
        *group,
        F.col("__days").alias("days"),
        (F.col("__days") / F.col("__all") * 100).alias("pct_of_sample"),
        "strategy_total_return",
        "benchmark_total_return",
        excess.alias("excess_return"),
        *[
            f"{s}_{short}"
            for short in ("sharpe", "max_drawdown", "win_rate")
            for s in ("strategy", "benchmark")
        ],
        (F.col("strategy_total_return") > F.col("benchmark_total_return")).alias("outperformed"),
    )


def regime_report(
    df: DataFrame, keys: Sequence[str] = KEYS, price: str = "close", **options
) -> DataFrame:
    """All three breakdowns.  Labels are computed on the rows passed in."""
    return performance_by_regime(label_regimes(df, price, keys=keys), keys=keys, **options)


def consistency_score(
    breakdown: DataFrame, keys: Sequence[str] = ("symbol", "breakdown")
) -> DataFrame:
    """In how many regimes the strategy won, and by how much at the extremes."""
    n, wins = F.count(F.lit(1)), F.count_if("outperformed")
    return breakdown.groupBy(*keys).agg(
        n.alias("n_regimes"),
        wins.alias("n_outperformed"),
        (wins / n * 100).alias("pct_outperformed"),
        F.min("excess_return").alias("worst_excess"),
        F.max("excess_return").alias("best_excess"),
        F.avg("excess_return").alias("mean_excess"),
    )
