import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.windows import Smooth, by_date, smooth
from barloom.operators.features import FEATURES, build_features
from barloom.operators.feature_stats import leakage_report, rebuild_test
from barloom.operators.indicators import oscillators
from tests.frames import local, to_spark, walk


def _closes(spark, values, symbol="AAA"):
    n = len(values)
    pdf = pd.DataFrame(
        {"symbol": symbol, "date": pd.bdate_range("2022-01-03", periods=n).date, "open": values,
         "high": values, "low": values, "close": values, "adj_close": values, "volume": 1e6}
    ).astype({"close": float, "open": float, "high": float, "low": float, "adj_close": float})
    return to_spark(spark, pdf)


def test_smoothers_match_pandas_over_block_boundaries(spark):
    pdf = walk(1700)
    df = smooth(
        to_spark(spark, pdf),
        {"e12": Smooth("ema", "close", 12), "e2": Smooth("ema", "close", 2),
         "e26": Smooth("ema", "close", 26), "w14": Smooth("wilder", "close", 14),
         "e1": Smooth("ema", "close", 1)},
    )
    got = local(df, "date")
    close = pdf["close"]
    for n in (1, 2, 12, 26):
        want = close.ewm(span=n, min_periods=n, adjust=False).mean()
        np.testing.assert_allclose(got[f"e{n}"].astype(float), want, rtol=1e-12)
    tail = close.iloc[13:].copy()
    tail.iloc[0] = close.iloc[:14].mean()
    want = tail.ewm(alpha=1 / 14, adjust=False).mean()
    assert got["w14"].iloc[:13].isna().all()
    np.testing.assert_allclose(got["w14"].iloc[13:].astype(float), want, rtol=1e-12)


def test_rsi_conventions(spark):
    def last(values, period=14):
        out = local(oscillators(_closes(spark, values), rsi_period=period), "date")
        return out["rsi"]

    assert last(list(range(1, 60))).iloc[-1] == 100
    assert last(list(range(60, 1, -1))).iloc[-1] == 0
    assert last([100.0] * 40).iloc[-1] == 50
    short = last([10, 11, 10.5, 12, 11.5], 3)
    assert short.iloc[:3].isna().all()
    gain, loss = (1 + 0 + 1.5) / 3, 0.5 / 3
    assert np.isclose(short.iloc[3], 100 - 100 / (1 + gain / loss))


def test_macd_signal_warm_up(spark):
    out = local(oscillators(to_spark(spark, walk(60))), "date")
    assert out["macd"].first_valid_index() == 25
    assert out["macd_signal"].first_valid_index() == 33
    assert out["atr"].first_valid_index() == 13
    assert out["rsi"].first_valid_index() == 14


def test_feature_names_and_warm_up(spark):
    assert len(FEATURES) == 43
    out = local(build_features(to_spark(spark, walk(120))), "date")
    assert len(out) == 60
    assert not out[FEATURES].isna().any().any()


def test_features_never_look_ahead(spark):
    pdf = pd.concat([walk(400), walk(350, seed=8, symbol="BBB")])
    found = local(rebuild_test(to_spark(spark, pdf)), "symbol")
    assert list(found["compared"]) == [43, 43]
    assert [list(o) for o in found["offenders"]] == [[], []]


def test_a_cheating_column_is_flagged(spark):
    df = build_features(to_spark(spark, walk(300)))
    cheat = df.withColumn("ret_1d", F.lead("ret_1d").over(by_date("symbol")))
    flagged = local(leakage_report(cheat)).query("suspicious")["feature"]
    assert "ret_1d" in set(flagged)
