"""Lagged positions, costs on turnover, equity, and the trade log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import KEYS, by_date, running
from barloom.operators.signals import buy_and_hold

RESULT = (
    "asset_return", "signal", "position", "turnover", "cost", "gross_return",
    "strategy_return", "equity", "benchmark_equity", "drawdown",
)
BPS = 10_000.0


def align(returns: DataFrame, signals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose dates both sides have; a missing return or signal becomes 0.

    It is an error when the two share no date at all.
    """
    both = returns.join(signals, [*keys, "date"])
    if both.isEmpty():
        raise ValueError("returns and signals have no date in common")
    return both.fillna(0.0, [c for c in ("asset_return", "signal") if c in both.columns])


def run_backtest(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    cost_bps: float | str = 5.0,
    slippage_bps: float | str = 2.0,
    lag: int = 1,
) -> DataFrame:
    """Add the per-bar result columns to rows with ``asset_return`` and ``signal``.

    A signal decided at one close is held from the next bar (``lag`` = 1; 0 is
    lookahead and only meant for tests).  ``keys`` are the stretches that start
    from a flat book: a symbol, or a symbol and a split, fold or grid point.
    Cost settings may be column names when they vary by row.
    """
    for v in (cost_bps, slippage_bps):
        if not isinstance(v, str) and v < 0:
            raise ValueError("costs must not be negative")
    if lag < 0:
        raise ValueError("lag must not be negative")
    w = by_date(*keys)
    bps = sum(
        (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (cost_bps, slippage_bps)),
        start=F.lit(0.0),
    )
    flat = F.lit(0.0)
    df = df.withColumns({c: F.coalesce(c, flat) for c in ("asset_return", "signal")})
    held = F.coalesce(F.lag("signal", lag).over(w), flat) if lag else F.col("signal")
    df = df.withColumns(
        {
            "position": held,
            "__before": F.coalesce(F.lag("signal", lag + 1).over(w), flat),
        }
    )
    df = df.withColumn("turnover", F.abs(F.col("position") - F.col("__before")))
    df = df.withColumns(
        {
            "cost": F.col("turnover") * bps / BPS,
            "gross_return": F.col("position") * F.col("asset_return"),
        }
    ).withColumn("strategy_return", F.col("gross_return") - F.col("cost"))
    df = df.withColumns(
        {
            "equity": running(F.product, 1 + F.col("strategy_return"), w),
            "benchmark_equity": running(F.product, 1 + F.col("asset_return"), w),
        }
    )
    # Peak of the curve itself; the metric of the same name in metrics.py also
    # counts the starting capital as a peak.
    below = {
        "drawdown": F.try_divide(F.col("equity"), running(F.max, "equity", w)) - 1,
        "benchmark_drawdown": F.try_divide(
            F.col("benchmark_equity"), running(F.max, "benchmark_equity", w)
        )
        - 1,
    }
    return df.withColumns(below).drop("__before")


def run_buy_and_hold(
    df: DataFrame, keys: Sequence[str] = KEYS, cost_bps: float = 0.0, slippage_bps: float = 0.0
) -> DataFrame:
    """Always long and still lagged, so the very first bar is flat."""
    return run_backtest(buy_and_hold(df), keys, cost_bps, slippage_bps)


def portfolio_value(
    df: DataFrame, initial_capital: float = 10_000.0
) -> DataFrame:
    return df.withColumns(
        {
            "portfolio_value": F.col("equity") * initial_capital,
            "benchmark_value": F.col("benchmark_equity") * initial_capital,
        }
    )


def trade_log(
    result: DataFrame, keys: Sequence[str] = KEYS, price: str | None = "close"
) -> DataFrame:
    """One row per round trip.

    A trade lasts while the position keeps its value.  Its cost covers its own
    bars and the bar after it, where leaving is charged; on a direct reversal
    that bar's cost is therefore counted for both trades.  A position still
    open on the last bar is closed there.
    """
    w = by_date(*keys)
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    r = result.withColumns(
        {"__new": (F.col("position") != before).cast("int"), "__exit_cost": F.lead("cost").over(w)}
    ).withColumn("__trade", running(F.sum, "__new", w))
    level = F.col(price) if price else F.lit(None).cast("double")
    trades = (
        r.where(F.col("position") != 0)
        .groupBy(*keys, "__trade")
        .agg(
            F.min("date").alias("entry_date"),
            F.max("date").alias("exit_date"),
            F.first("position").alias("__side"),
            F.count(F.lit(1)).cast("int").alias("holding_days"),
            F.min_by(level, "date").alias("entry_price"),
            F.max_by(level, "date").alias("exit_price"),
            (F.product(1 + F.col("position") * F.col("asset_return")) - 1).alias("gross_return"),
            (
                F.sum("cost")
                + F.coalesce(F.max_by("__exit_cost", "date"), F.lit(0.0))
            ).alias("cost"),
        )
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    )
    return trades.select(
        *keys,
        "entry_date",
        "exit_date",
        F.when(F.col("__side") > 0, "long").otherwise("short").alias("direction"),
        "holding_days",
        "entry_price",
        "exit_price",
        "gross_return",
        "cost",
        "net_return",
        (F.col("net_return") > 0).alias("win"),
    )


def entered(keys: Sequence[str] = KEYS) -> Column:
    """True on the first bar of every round trip."""
    before = F.coalesce(F.lag("position").over(by_date(*keys)), F.lit(0.0))
    return (F.col("position") != before) & (F.col("position") != 0)


def backtest_totals(result: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of trades, total cost and exposure per key, without the trade log."""
    return (
        result.withColumn("__entered", entered(keys))
        .groupBy(*keys)
        .agg(
            F.count_if("__entered").alias("n_trades"),
            F.sum("cost").alias("total_cost"),
            F.avg((F.col("position") != 0).cast("double")).alias("exposure"),
        )
    )
