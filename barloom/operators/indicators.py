"""Technical indicators as column-adding operators.  All look backward only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import col, ratio
from barloom.functions.windows import KEYS, Smooth, by_date, roll, running, smooth


def zscore(x: str | Column, n: int, w: WindowSpec) -> Column:
    """Distance from the trailing mean in population standard deviations."""
    x = col(x)
    return ratio(x - roll(F.avg, x, n, w), roll(F.stddev_pop, x, n, w))


def true_range(w: WindowSpec) -> Column:
    """Largest of the three ranges; the first bar has only high - low."""
    before = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - before),
        F.abs(F.col("low") - before),
    )


def stochastic_k(n: int, w: WindowSpec) -> Column:
    top, bottom = roll(F.max, "high", n, w), roll(F.min, "low", n, w)
    return ratio(100.0 * (F.col("close") - bottom), top - bottom)


def signed_volume(w: WindowSpec) -> Column:
    """Volume with the sign of the price change; 0 on the first bar."""
    change = F.col("close") - F.lag("close").over(w)
    return F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume")


def obv(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    w = by_date(*keys)
    return (
        df.withColumn("__flow", signed_volume(w))
        .withColumn("obv", running(F.sum, "__flow", w))
        .drop("__flow")
    )


def bollinger(n: int, width: float, w: WindowSpec) -> dict[str, Column]:
    """Middle, upper and lower band, position within and width of the band."""
    mid, sd = roll(F.avg, "close", n, w), roll(F.stddev_pop, "close", n, w)
    upper, lower = mid + width * sd, mid - width * sd
    return {
        "bb_middle": mid,
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_pct_b": ratio(F.col("close") - lower, upper - lower),
        "bb_bandwidth": ratio(upper - lower, mid),
    }


def rsi_inputs(w: WindowSpec) -> dict[str, Column]:
    """Gains and losses per bar.  The first bar has neither (not zero)."""
    delta = F.col("close") - F.lag("close").over(w)
    return {
        "__gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "__loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
    }


def rsi_from(gain: str, loss: str) -> Column:
    """100 without losses, 50 on a flat series, missing until both are seeded."""
    g, lo = F.col(gain), F.col(loss)
    return (
        F.when(g.isNull(), None)
        .when((lo == 0) & (g == 0), 50.0)
        .when(lo == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + ratio(g, lo)))
    )


def oscillators(
    df: DataFrame,
    rsi_period: int = 14,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    atr_period: int = 14,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every recursive indicator in two scans.

    Adds ``ema_fast``, ``ema_slow`` (12/26 by default, also the MACD legs),
    ``rsi``, ``macd``, ``macd_signal``, ``macd_hist`` and ``atr``.  The signal
    line starts at the first MACD value, so it needs its own second scan.
    """
    w = by_date(*keys)
    df = df.withColumns({**rsi_inputs(w), "__tr": true_range(w)})
    df = smooth(
        df,
        {
            "ema_fast": Smooth("ema", "close", fast),
            "ema_slow": Smooth("ema", "close", slow),
            "__g": Smooth("wilder", "__gain", rsi_period),
            "__l": Smooth("wilder", "__loss", rsi_period),
            "atr": Smooth("wilder", "__tr", atr_period),
        },
        keys,
    )
    df = df.withColumns(
        {"rsi": rsi_from("__g", "__l"), "macd": F.col("ema_fast") - F.col("ema_slow")}
    )
    df = smooth(df, {"macd_signal": Smooth("ema", "macd", signal)}, keys)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(
        "__gain", "__loss", "__tr", "__g", "__l"
    )
