"""Parameter sweeps: one backtest pass over rows times grid points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import KEYS, by_date, linspace_edges
from barloom.operators.backtest import entered, run_backtest
from barloom.operators.metrics import performance
from barloom.operators.signals import generate_signals, grid

FIELDS = (
    "total_return", "cagr", "sharpe_ratio", "max_drawdown", "win_rate",
    "exposure", "n_trades", "total_cost", "final_equity",
)


def score_runs(
    df: DataFrame,
    keys: Sequence[str],
    threshold: float | Column = 0.0,
    cost_bps: float | str = 5.0,
    slippage_bps: float | str = 2.0,
    allow_short: bool = False,
) -> DataFrame:
    """Nine summary fields and the buy-and-hold return for every key.

    Expects ``asset_return`` and ``prediction``.  Keys start with the symbol, so
    rows already partitioned by symbol are not shuffled again.
    """
    signalled = generate_signals(df, "prediction", threshold, allow_short)
    result = run_backtest(signalled, keys, cost_bps, slippage_bps)
    scored = performance(
        result.withColumn("__entered", entered(keys)),
        {"strategy": "strategy_return", "benchmark": "asset_return"},
        keys,
        positions={"strategy": "position"},
        extra={"n_trades": F.count_if("__entered"), "total_cost": F.sum("cost")},
    )
    of = {s: F.col("series") == s for s in ("strategy", "benchmark")}
    main = ("total_return", "cagr", "sharpe_ratio", "max_drawdown", "win_rate", "exposure")
    summary = scored.groupBy(*keys).agg(
        *[F.max(F.when(of["strategy"], F.col(c))).alias(c) for c in main],
        F.max(F.when(of["benchmark"], F.col("total_return"))).alias("buy_and_hold_return"),
        F.max("n_trades").alias("n_trades"),
        F.max("total_cost").alias("total_cost"),
    )
    return summary.select(
        *keys,
        *main,
        "n_trades",
        "total_cost",
        (F.col("total_return") + 1).alias("final_equity"),
        "buy_and_hold_return",
        (F.col("total_return") - F.col("buy_and_hold_return")).alias("excess_return"),
        (F.col("total_return") > F.col("buy_and_hold_return")).alias("beats_buy_and_hold"),
    )


def sweep_costs(
    df: DataFrame, costs: Sequence[float], keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    """Vary the commission.  Slippage is zero here, unlike in the other sweeps."""
    runs = score_runs(
        grid(df, "cost_bps", costs), [*keys, "cost_bps"],
        cost_bps="cost_bps", slippage_bps=0.0, **options,
    )
    return runs.drop("buy_and_hold_return", "excess_return")


def sweep_thresholds(
    df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    runs = score_runs(
        grid(df, "threshold", thresholds), [*keys, "threshold"],
        threshold=F.col("threshold"), **options,
    )
    return runs.drop("buy_and_hold_return", "excess_return")


def sweep_symbols(df: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """The same rule on every symbol: the panel is grouped that way already."""
    return score_runs(df, keys, **options)


def sweep_seeds(stacked: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """Score predictions stacked by a ``seed`` column (one fit per seed)."""
    runs = score_runs(stacked, [*keys, "seed"], **options)
    return runs.drop("buy_and_hold_return", "excess_return", "beats_buy_and_hold")


def with_periods(
    df: DataFrame, n_periods: int = 4, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add ``period`` 1..n: consecutive blocks of (nearly) equal row counts."""
    if n_periods < 1:
        raise ValueError("n_periods must be at least 1")
    df = df.withColumns(
        {
            "__pos": F.row_number().over(by_date(*keys)) - 1,
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    edges = linspace_edges(0, F.col("__n"), n_periods)
    block = F.size(F.filter(edges, lambda e: e <= F.col("__pos")))
    return df.withColumn("period", block).drop("__pos", "__n")


def sweep_periods(
    df: DataFrame,
    n_periods: int = 4,
    min_rows: int = 20,
    keys: Sequence[str] = KEYS,
    **options,
) -> DataFrame:
    """Score consecutive blocks.  Each starts flat; returns are not recomputed."""
    blocks = with_periods(df, n_periods, keys)
    group = [*keys, "period"]
    span = (
        blocks.groupBy(*group)
        .agg(
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count(F.lit(1)).alias("days"),
        )
        .where(F.col("days") >= min_rows)
    )
    return span.join(score_runs(blocks, group, **options), group)


def break_even_cost(
    sweep: DataFrame, benchmark: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Highest cost that still beats the benchmark; NULL when none does."""
    won = (
        F.col("total_return") > F.col(benchmark) if benchmark else F.col("beats_buy_and_hold")
    )
    return sweep.groupBy(*keys).agg(
        F.max(F.when(won, F.col("cost_bps"))).alias("break_even_cost_bps")
    )


def stack_sweeps(sweeps: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Sweeps under one ``sweep`` label; seeds have no benchmark column."""
    flag = "beats_buy_and_hold"
    parts = [
        df.select(
            *keys,
            F.lit(name).alias("sweep"),
            "total_return",
            "sharpe_ratio",
            (F.col(flag) if flag in df.columns else F.lit(None).cast("boolean")).alias(flag),
        )
        for name, df in sweeps.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def robustness_summary(
    sweeps: dict[str, DataFrame], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Range of outcomes and share of winners per sweep."""
    return stack_sweeps(sweeps, keys).groupBy(*keys, "sweep").agg(
        F.count(F.lit(1)).alias("n_configurations"),
        F.min("total_return").alias("return_min"),
        F.max("total_return").alias("return_max"),
        F.avg("total_return").alias("return_mean"),
        F.stddev_samp("total_return").alias("return_std"),
        F.min("sharpe_ratio").alias("sharpe_min"),
        F.max("sharpe_ratio").alias("sharpe_max"),
        (F.avg(F.col("beats_buy_and_hold").cast("double")) * 100).alias("pct_beating_benchmark"),
    )


def stress_verdict(summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overall reading: mean winning share of the sweeps, and fragility.

    ``robust`` from 75 percent, ``mixed`` from 40, else ``no_edge``; ``unknown``
    when no sweep could be compared with a benchmark.
    """
    rate, spread = F.avg("pct_beating_benchmark"), F.max("return_std")
    return summary.groupBy(*keys).agg(
        rate.alias("mean_beat_rate"),
        F.when(rate.isNull(), "unknown")
        .when(rate >= 75, "robust")
        .when(rate >= 40, "mixed")
        .otherwise("no_edge")
        .alias("verdict"),
        F.coalesce(spread > 0.5, F.lit(False)).alias("fragile"),
    )
