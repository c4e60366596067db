import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators.backtest import run_backtest, run_buy_and_hold, trade_log
from barloom.operators.metrics import performance_summary, trade_statistics
from barloom.operators.signals import signal_of, signal_summary
from barloom.operators.stress import sweep_costs, sweep_periods
from tests.frames import local

SCHEMA = "symbol string, date date, asset_return double, signal double, close double"


def _rows(spark, returns, signal):
    dates = pd.bdate_range("2022-01-03", periods=len(returns)).date
    close = 100 * np.cumprod(1 + np.asarray(returns))
    data = [("AAA", d, float(r), float(s), float(c)) for d, r, s, c in zip(dates, returns, signal, close)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def returns():
    return np.random.default_rng(5).normal(0.0005, 0.012, 300)


def _brute_trades(position, returns, cost):
    out, start = [], None
    for i in range(len(position) + 1):
        now = position[i] if i < len(position) else 0.0
        before = position[i - 1] if i else 0.0
        if now != before:
            if before != 0:
                span = slice(start, i)
                gross = np.prod(1 + before * returns[span]) - 1
                out.append((start, i - 1, gross, cost[start : min(i + 1, len(cost))].sum()))
            start = i
    return out


def test_trade_log_against_brute_force(spark, returns):
    signal = np.zeros(300)
    signal[10:20] = 1
    signal[30:40] = -1
    signal[40:50] = 1
    signal[70:80] = 1
    signal[290:] = 1
    result = run_backtest(_rows(spark, returns, signal))
    day = local(result, "date")
    trades = local(trade_log(result), "entry_date")
    brute = _brute_trades(day["position"].to_numpy(), returns, day["cost"].to_numpy())
    assert len(trades) == len(brute) == 5
    dates = list(day["date"])
    for row, (a, b, gross, cost) in zip(trades.itertuples(), brute):
        assert (row.entry_date, row.exit_date) == (dates[a], dates[b])
        assert row.holding_days == b - a + 1
        assert math.isclose(row.gross_return, gross, rel_tol=1e-12)
        assert math.isclose(row.cost, cost, rel_tol=1e-12)
    assert trades["entry_date"][0] == dates[11] and trades["exit_date"][0] == dates[20]
    assert list(trades["direction"][:2]) == ["long", "short"]


def test_lag_and_costs(spark, returns):
    signal = np.sign(returns)
    out = local(run_backtest(_rows(spark, returns, signal), cost_bps=5, slippage_bps=2), "date")
    want = np.r_[0.0, signal[:-1]]
    np.testing.assert_array_equal(out["position"], want)
    turnover = np.abs(np.diff(want, prepend=0.0))
    np.testing.assert_allclose(out["cost"], turnover * 7e-4)
    net = want * returns - turnover * 7e-4
    np.testing.assert_allclose(out["equity"], np.cumprod(1 + net), rtol=1e-12)
    cheat = local(run_backtest(_rows(spark, returns, signal), lag=0), "date")
    assert cheat["equity"].iloc[-1] > 10 * out["equity"].iloc[-1]


def test_buy_and_hold_is_flat_on_the_first_bar(spark, returns):
    out = local(run_buy_and_hold(_rows(spark, returns, np.zeros(300))), "date")
    np.testing.assert_allclose(out["equity"].iloc[-1], np.prod(1 + returns[1:]), rtol=1e-12)


def _summary(spark, values):
    rows = _rows(spark, values, np.zeros(len(values)))
    return performance_summary(rows, "asset_return").first()


def test_metric_literals(spark):
    assert _summary(spark, [0.5, -0.5])["max_drawdown"] == -0.5
    first_day = _summary(spark, [-0.10, 0.0])
    assert math.isclose(first_day["max_drawdown"], -0.10)
    assert first_day["max_drawdown_days"] == 2
    flat = _summary(spark, [0.001] * 252)
    assert flat["sharpe_ratio"] is None and flat["sortino_ratio"] is None
    assert math.isclose(flat["cagr"], flat["total_return"], rel_tol=1e-9)
    assert flat["profit_factor"] == float("inf")
    assert _summary(spark, [-1.0, 0.5])["cagr"] == -1.0


def test_metrics_against_numpy(spark, returns):
    got = _summary(spark, returns)
    sd = returns.std(ddof=1)
    assert math.isclose(got["sharpe_ratio"], returns.mean() / sd * 252**0.5, rel_tol=1e-9)
    down = returns[returns < 0].std(ddof=1) * 252**0.5
    assert math.isclose(got["sortino_ratio"], returns.mean() * 252 / down, rel_tol=1e-9)
    var = np.quantile(returns, 0.05)
    assert math.isclose(got["var_95"], var, rel_tol=1e-9)
    assert math.isclose(got["cvar_95"], returns[returns <= var].mean(), rel_tol=1e-9)
    equity = np.cumprod(1 + returns)
    dd = equity / np.maximum(np.maximum.accumulate(equity), 1.0) - 1
    assert math.isclose(got["max_drawdown"], dd.min(), rel_tol=1e-9)
    longest = run = 0
    for wet in dd < -1e-12:
        run = run + 1 if wet else 0
        longest = max(longest, run)
    assert got["max_drawdown_days"] == longest


def test_trade_statistics(spark):
    rows = [("AAA", n, h) for n, h in zip([0.05, -0.02, 0.03, -0.01], [5, 3, 7, 1])]
    df = spark.createDataFrame(rows, "symbol string, net_return double, holding_days int")
    got = trade_statistics(df).first()
    assert (got["n_trades"], got["n_wins"], got["win_rate"]) == (4, 2, 0.5)
    assert math.isclose(got["payoff_ratio"], 0.04 / 0.015)
    assert got["avg_holding_days"] == 4.0


def test_signal_edges(spark):
    df = spark.createDataFrame([(0.02,), (0.01,), (-0.02,), (None,)], "p double")
    assert [r[0] for r in df.select(signal_of("p", 0.01, True)).collect()] == [1, 0, -1, 0]
    assert [r[0] for r in df.select(signal_of("p", 0.01)).collect()] == [1, 0, 0, 0]
    with pytest.raises(ValueError):
        signal_of("p", -0.1)


def test_signal_summary_counts_the_first_row(spark):
    got = signal_summary(_rows(spark, [0.0] * 6, [1, 1, 0, 0, -1, -1])).first()
    assert got["n_changes"] == 3
    assert math.isclose(got["avg_holding_days"], 4 / 3)


def test_returns_fall_with_cost(spark, returns):
    rows = _rows(spark, returns, np.zeros(300)).withColumnRenamed("signal", "prediction")
    rows = rows.withColumn("prediction", rows["asset_return"])
    swept = local(sweep_costs(rows, (0, 5, 20)), "cost_bps")
    assert swept["total_return"].is_monotonic_decreasing
    periods = local(sweep_periods(rows, 4), "period")
    assert list(periods["days"]) == [75] * 4


def test_align_needs_a_shared_date(spark):
    import pytest

    from barloom.operators.backtest import align

    a = spark.createDataFrame([("A", "2024-01-01", None), ("A", "2024-01-02", 0.1)], "symbol string, date string, asset_return double")
    b = spark.createDataFrame([("A", "2024-01-01", 1.0)], "symbol string, date string, signal double")
    assert [tuple(r) for r in align(a, b).collect()] == [("A", "2024-01-01", 0.0, 1.0)]
    with pytest.raises(ValueError, match="no date"):
        align(a, b.selectExpr("symbol", "'2025-01-01' AS date", "signal"))
