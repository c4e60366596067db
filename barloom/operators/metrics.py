"""Performance and risk metrics, grouped by any keys, several series at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TRADING_DAYS, finite, mean_when
from barloom.functions.ranks import quantiles
from barloom.functions.windows import KEYS, by_date, running

TINY = 1e-12

#: Metric names in report order.
METRICS = (
    "total_return", "cagr", "avg_daily_return", "annualised_volatility",
    "sharpe_ratio", "sortino_ratio", "max_drawdown", "max_drawdown_days",
    "calmar_ratio", "win_rate", "profit_factor", "var_95", "cvar_95", "n_days",
)


def equity_curve(
    df: DataFrame, r: str = "strategy_return", initial: float = 1.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    grown = running(F.product, 1 + finite(r), by_date(*keys))
    return df.where(finite(r).isNotNull()).withColumn("equity_curve", grown * initial)


def path_columns(
    df: DataFrame, series: Mapping[str, str], keys: Sequence[str] = KEYS, order: str = "date"
) -> DataFrame:
    """Per-row path statistics of each return column.

    For label ``x`` adds ``x__r`` (finite return), ``x__dd`` (drawdown, with the
    starting capital as the first peak) and ``x__run`` (bars under water in a
    row).  Rows with a missing return are skipped, not counted.
    """
    w = by_date(*keys, order=order)
    df = df.withColumns({f"{x}__r": finite(c) for x, c in series.items()})
    df = df.withColumns(
        {
            **{f"{x}__eq": running(F.product, 1 + F.col(f"{x}__r"), w) for x in series},
            **{f"{x}__pos": running(F.count, f"{x}__r", w) for x in series},
        }
    )
    df = df.withColumns(
        {
            f"{x}__dd": F.when(
                F.col(f"{x}__r").isNotNull(),
                F.col(f"{x}__eq") / F.greatest(running(F.max, f"{x}__eq", w), F.lit(1.0)) - 1,
            )
            for x in series
        }
    )
    dry = {
        x: F.when(F.col(f"{x}__dd") >= -TINY, F.col(f"{x}__pos")) for x in series
    }
    return df.withColumns(
        {
            f"{x}__run": F.col(f"{x}__pos")
            - F.coalesce(running(F.max, dry[x], w), F.lit(0).cast("bigint"))
            for x in series
        }
    ).drop(*[f"{x}__{s}" for x in series for s in ("eq", "pos")])


def drawdown_series(
    df: DataFrame, r: str = "strategy_return", keys: Sequence[str] = KEYS
) -> DataFrame:
    return path_columns(df, {"x": r}, keys).where(F.col("x__r").isNotNull()).select(
        *keys, "date", F.col("x__dd").alias("drawdown"), F.col("x__run").alias("days_under_water")
    )


def _record(x: str, rf: float, days: int, positions: str | None) -> Column:
    """All metrics of one series as a struct of aggregates."""
    r, dd = F.col(f"{x}__r"), F.col(f"{x}__dd")
    n, mean, sd = F.count(r), F.avg(r), F.stddev_samp(r)
    root = math.sqrt(days)
    growth = F.product(1 + r)
    down = F.stddev_samp(F.when(r < 0, r)) * root
    cagr = F.when(n < 2, None).when(growth <= 0, -1.0).otherwise(
        F.pow(growth, F.lit(float(days)) / n) - 1
    )
    worst = F.min(dd)
    gains = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    excess = mean - rf / days
    fields = {
        "total_return": growth - 1,
        "cagr": cagr,
        "avg_daily_return": mean,
        "annualised_volatility": sd * root,
        "sharpe_ratio": F.when(sd >= TINY, excess / sd * root),
        "sortino_ratio": F.when((n >= 2) & (down >= TINY), excess * days / down),
        "max_drawdown": worst,
        "max_drawdown_days": F.coalesce(F.max(f"{x}__run"), F.lit(0)).cast("bigint"),
        "calmar_ratio": F.when(F.abs(worst) >= TINY, cagr / F.abs(worst)),
        "win_rate": mean_when(F.when(r != 0, r > 0)),
        "profit_factor": F.when(losses > 0, F.try_divide(gains, losses)).when(
            gains > 0, float("inf")
        ),
        "var_95": F.first(f"{x}__var", ignorenulls=True),
        "cvar_95": F.avg(F.when(r <= F.col(f"{x}__var"), r)),
        "n_days": n,
        "exposure": mean_when(F.when(F.col(positions).isNotNull(), F.col(positions) != 0))
        if positions
        else F.lit(None).cast("double"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def performance(
    df: DataFrame,
    series: Mapping[str, str],
    keys: Sequence[str] = KEYS,
    rf: float = 0.0,
    days: int = TRADING_DAYS,
    positions: Mapping[str, str] | None = None,
    var_level: float = 0.05,
    order: str = "date",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key and series label with every metric.

    ``series`` maps labels to return columns; they are measured side by side
    in one pass over rows that share one window order, so comparing with a
    benchmark costs no second scan and no self-join.  ``extra`` names further
    aggregates of the same rows to carry along.
    """
    positions, extra = positions or {}, extra or {}
    df = path_columns(df, series, keys, order)
    if "symbol" in keys:
        group = Window.partitionBy(*keys)
        df = df.withColumns(
            {f"{x}__var": F.percentile(f"{x}__r", F.lit(var_level)).over(group) for x in series}
        )
    else:
        for x in series:
            cuts = quantiles(df, f"{x}__r", [var_level], keys, "__cut")
            cuts = cuts.select(*keys, F.col("__cut")[0].alias(f"{x}__var"))
            if keys:
                df = df.join(cuts, list(keys))
            else:
                found = cuts.first()
                df = df.withColumn(f"{x}__var", F.lit(found and found[0]).cast("double"))
    wide = df.groupBy(*keys).agg(
        *[_record(x, rf, days, positions.get(x)).alias(f"rec_{x}") for x in series],
        *[c.alias(name) for name, c in extra.items()],
    )
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(x).alias("series"), F.col(f"rec_{x}").alias("m")) for x in series]
        )
    )
    return wide.select(*keys, *extra, rows.alias("row")).select(
        *keys, *extra, "row.series", "row.m.*"
    )


def performance_summary(
    df: DataFrame,
    r: str = "strategy_return",
    keys: Sequence[str] = KEYS,
    position: str | None = None,
    **options,
) -> DataFrame:
    """The metric record of one return column per key."""
    out = performance(
        df, {"x": r}, keys, positions={"x": position} if position else None, **options
    ).drop("series")
    return out if position else out.drop("exposure")


def long_form(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) rows of a metric record."""
    names = [c for c in summary.columns if c in METRICS or c == "exposure"]
    return summary.select(
        *keys, *[F.col(c).cast("double").alias(c) for c in names]
    ).unpivot(list(keys), names, "metric", "value")


def compare_to_benchmark(
    result: DataFrame,
    keys: Sequence[str] = KEYS,
    strategy: str = "strategy_return",
    benchmark: str = "asset_return",
    position: str | None = "position",
    **options,
) -> DataFrame:
    """(keys, metric, strategy, buy_and_hold, difference) rows."""
    both = performance(
        result,
        {"strategy": strategy, "buy_and_hold": benchmark},
        keys,
        positions={"strategy": position} if position else None,
        **options,
    )
    if not position:
        both = both.drop("exposure")
    tall = long_form(both, [*keys, "series"])
    return (
        tall.groupBy(*keys, "metric")
        .pivot("series", ["strategy", "buy_and_hold"])
        .agg(F.first("value"))
        .withColumn("difference", F.col("strategy") - F.col("buy_and_hold"))
    )


def summary_table(summaries: DataFrame, run: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs as rows, metrics as columns, from (keys, run, metric, value) rows."""
    return summaries.groupBy(*keys, run).pivot("metric").agg(F.first("value"))


def trade_statistics(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Eleven statistics of a trade log; a loss is any trade that gained nothing."""
    net = F.col("net_return")
    won, lost = F.when(net > 0, net), F.when(net <= 0, net)
    n = F.count(F.lit(1))
    return trades.groupBy(*keys).agg(
        n.alias("n_trades"),
        F.count(won).alias("n_wins"),
        F.count(lost).alias("n_losses"),
        (F.count(won) / n).alias("win_rate"),
        F.avg(won).alias("avg_win"),
        F.avg(lost).alias("avg_loss"),
        F.avg(net).alias("avg_trade"),
        F.max(net).alias("best_trade"),
        F.min(net).alias("worst_trade"),
        F.avg("holding_days").alias("avg_holding_days"),
        F.try_divide(F.avg(won), F.abs(F.avg(lost))).alias("payoff_ratio"),
    )
