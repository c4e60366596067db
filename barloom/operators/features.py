"""The feature matrix: stationary, strictly backward-looking columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import FeatureSpec
from barloom.functions.columns import TRADING_DAYS, ratio
from barloom.functions.session import tune
from barloom.functions.windows import KEYS, Smooth, by_date, roll, running, smooth
from barloom.operators.cleaning import adjust_ohlc
from barloom.operators.indicators import (
    bollinger,
    rsi_from,
    rsi_inputs,
    signed_volume,
    stochastic_k,
    true_range,
    zscore,
)

ANNUAL = math.sqrt(TRADING_DAYS)
STOCH_WINDOW = 14
DOWNSIDE_WINDOW = 20
YEAR_WINDOW, YEAR_MIN = 252, 60
RATIO_SPANS = (12, 26)

#: Price-level columns kept for charts; never model inputs.
LEVELS = ("bb_middle", "bb_upper", "bb_lower", "volume_sma", "obv", "atr")


def _trend_pair(spec: FeatureSpec) -> tuple[int, int] | None:
    s = spec.sma_windows
    if len(s) < 2:
        return None
    return s[0], s[2] if len(s) > 2 else s[1]


def feature_names(spec: FeatureSpec = FeatureSpec()) -> list[str]:
    """The model inputs, in build order (43 with the default settings)."""
    names = ["ret_1d"]
    names += [f"ret_{n}d" for n in spec.return_windows if n != 1]
    names += [f"ret_lag_{k}" for k in spec.return_lags]
    names += ["log_ret_1d"]
    names += [f"close_sma_{n}_ratio" for n in spec.sma_windows]
    if pair := _trend_pair(spec):
        names += [f"sma_{pair[0]}_{pair[1]}_ratio"]
    names += ["ema_12_26_ratio"]
    names += [f"vol_{n}" for n in spec.volatility_windows]
    if len(spec.volatility_windows) >= 2:
        a, b = spec.volatility_windows[:2]
        names += [f"vol_ratio_{a}_{b}"]
    names += [
        "downside_vol_20", "volume_change", "volume_ratio", "volume_zscore",
        "dollar_volume_ratio", "obv_zscore", "high_low_range", "close_position",
        "gap_open", f"rsi_{spec.rsi_period}", "macd_norm", "macd_signal_norm",
        "macd_hist_norm", "bb_pct_b", "bb_bandwidth", "atr_pct", "stoch_k",
        "dist_from_52w_high", "dist_from_52w_low",
    ]
    if spec.include_calendar:
        names += ["day_of_week", "month", "month_sin", "month_cos"]
    return names


FEATURES = feature_names()


def rows_needed(spec: FeatureSpec = FeatureSpec()) -> dict[str, int]:
    """Bars up to and including the current one that each group of features reads.

    The recursive smoothers are counted with the bars after which they are
    defined; what older bars add to them fades.
    """
    one_more = {
        "returns": max(*spec.return_windows, *spec.volatility_windows, 20),
        "lags": 1 + max(spec.return_lags),
        "volume": 1 + spec.volume_window,
        "rsi": spec.rsi_period,
    }
    return {
        **{k: n + 1 for k, n in one_more.items()},
        "averages": max(spec.sma_windows),
        "bollinger": spec.bollinger_window,
        "macd": spec.macd_slow + spec.macd_signal,
        "atr": spec.atr_period + 1,
        "stochastic": STOCH_WINDOW,
        "year_range": YEAR_WINDOW,
    }


def look_back(spec: FeatureSpec = FeatureSpec()) -> int:
    """Bars that an incremental run must read for one complete row of features."""
    return max(rows_needed(spec).values())


def carries(spec: FeatureSpec = FeatureSpec()) -> dict[str, str]:
    """What a series carries from bar to bar besides a tail of bars, and the working column it comes from."""
    spans = sorted({*RATIO_SPANS, spec.macd_fast, spec.macd_slow})
    return {
        **{f"ema_{n}": f"__ema_{n}" for n in spans},
        "g": "__g", "l": "__l", "atr": "atr", "macd_signal": "__macd_signal", "obv": "obv",
    }


def feature_matrix(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Keys and model inputs only, in a stable column order."""
    return df.select("symbol", "date", *feature_names(spec))


def build_features(
    bars: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    dropna: bool = True,
    keys: Sequence[str] = KEYS,
    age: str | None = None,
    carried: bool = False,
) -> DataFrame:
    """Clean bars in, adjusted bars plus levels plus every feature out.

    ``dropna`` removes each row that lacks any feature: the warm-up, and also
    rows in mid-series such as flat bars.  What follows is computed on the
    surviving rows.

    The columns are added in layers so that no expression nests windows.  Every
    window except the block sums of the smoothers shares one specification;
    the plan has a single exchange on ``keys``.

    ``carried`` adds the columns ``c_*`` that a later run needs to go on from
    here (see ``carries``); ``age`` names the column that says where such a run
    starts (see ``smooth``).
    """
    tune(bars.sparkSession)
    w = by_date(*keys)
    close, volume = F.col("close"), F.col("volume")
    prev = F.lag("close").over(w)
    df = adjust_ohlc(bars)

    # Layer 1: windows over the bars themselves.
    first = {
        "ret_1d": ratio(close, prev) - 1,
        "log_ret_1d": F.ln(ratio(close, prev)),
        "__delta_flow": signed_volume(w),
        "__dollar": close * volume,
        "__tr": true_range(w),
        **rsi_inputs(w),
        "volume_change": ratio(volume, F.lag("volume").over(w)) - 1,
        "volume_sma": roll(F.avg, "volume", spec.volume_window, w),
        "volume_zscore": zscore("volume", spec.volume_window, w),
        "gap_open": ratio(F.col("open") - prev, prev),
        "stoch_k": stochastic_k(STOCH_WINDOW, w),
        "dist_from_52w_high": ratio(close, roll(F.max, "close", YEAR_WINDOW, w, YEAR_MIN)) - 1,
        "dist_from_52w_low": ratio(close, roll(F.min, "close", YEAR_WINDOW, w, YEAR_MIN)) - 1,
        **bollinger(spec.bollinger_window, spec.bollinger_std, w),
    }
    first |= {
        f"ret_{n}d": ratio(close, F.lag("close", n).over(w)) - 1
        for n in spec.return_windows
        if n != 1
    }
    first |= {f"sma_{n}": roll(F.avg, "close", n, w) for n in spec.sma_windows}
    if age:
        # the first bar of a stored tail brings the flow of everything before it
        begins = F.col(age).isNotNull() & F.lag("date").over(w).isNull()
        first["__delta_flow"] = F.when(begins, F.col("c_obv")).otherwise(first["__delta_flow"])
    df = df.withColumns(first)

    # Layer 2: windows over returns and flows, and the recursive smoothers.
    ret = F.col("ret_1d")
    loss_only = F.when(ret < 0, ret).otherwise(0.0)
    second = {f"ret_lag_{k}": F.lag("ret_1d", k).over(w) for k in spec.return_lags}
    second |= {
        f"vol_{n}": roll(F.stddev_samp, ret, n, w) * ANNUAL
        for n in spec.volatility_windows
    }
    second |= {
        "downside_vol_20": roll(F.stddev_samp, loss_only, DOWNSIDE_WINDOW, w) * ANNUAL,
        "obv": running(F.sum, "__delta_flow", w),
        "dollar_volume_ratio": ratio(
            "__dollar", roll(F.avg, "__dollar", spec.volume_window, w)
        ),
    }
    df = df.withColumns(second)
    df = df.withColumn("obv_zscore", zscore("obv", spec.volume_window, w))
    spans = {*RATIO_SPANS, spec.macd_fast, spec.macd_slow}
    df = smooth(
        df,
        {
            **{f"__ema_{n}": Smooth("ema", "close", n) for n in spans},
            "__g": Smooth("wilder", "__gain", spec.rsi_period),
            "__l": Smooth("wilder", "__loss", spec.rsi_period),
            "atr": Smooth("wilder", "__tr", spec.atr_period),
        },
        keys,
        age=age,
    )
    df = df.withColumn(
        "__macd", F.col(f"__ema_{spec.macd_fast}") - F.col(f"__ema_{spec.macd_slow}")
    )
    df = smooth(df, {"__macd_signal": Smooth("ema", "__macd", spec.macd_signal)}, keys, age=age)

    # Layer 3: scale-free ratios of what is there by now.
    span = F.col("high") - F.col("low")
    third = {
        f"close_sma_{n}_ratio": ratio(close, f"sma_{n}") for n in spec.sma_windows
    }
    if pair := _trend_pair(spec):
        third[f"sma_{pair[0]}_{pair[1]}_ratio"] = ratio(f"sma_{pair[0]}", f"sma_{pair[1]}")
    if len(spec.volatility_windows) >= 2:
        a, b = spec.volatility_windows[:2]
        third[f"vol_ratio_{a}_{b}"] = ratio(f"vol_{a}", f"vol_{b}")
    third |= {
        "ema_12_26_ratio": ratio(*[f"__ema_{n}" for n in RATIO_SPANS]),
        "volume_ratio": ratio(volume, "volume_sma"),
        "high_low_range": ratio(span, close),
        "close_position": ratio(close - F.col("low"), span),
        f"rsi_{spec.rsi_period}": rsi_from("__g", "__l"),
        "macd_norm": ratio("__macd", close),
        "macd_signal_norm": ratio("__macd_signal", close),
        "macd_hist_norm": ratio(F.col("__macd") - F.col("__macd_signal"), close),
        "atr_pct": ratio("atr", close),
    }
    if spec.include_calendar:
        month = F.month("date").cast("double")
        third |= {
            "day_of_week": F.weekday("date").cast("double"),
            "month": month,
            "month_sin": F.sin(2 * math.pi * month / 12),
            "month_cos": F.cos(2 * math.pi * month / 12),
        }
    df = df.withColumns(third)

    names = feature_names(spec)
    out = df.select(
        *keys, "date", "open", "high", "low", "close", "adj_close", "volume",
        *[f"sma_{n}" for n in spec.sma_windows], *LEVELS, *names,
        *([F.col(inner).alias(f"c_{c}") for c, inner in carries(spec).items()] if carried else []),
    )
    return out.dropna(subset=names) if dropna else out
