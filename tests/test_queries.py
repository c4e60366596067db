"""Registered queries against their SQL, and study-level behaviour."""

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from barloom.operators.evaluate import classification_metrics, regression_metrics
from barloom.operators.regimes import volatility_regime
from barloom.operators.target import check_split, chronological_split, make_target
from tests.frames import linear_bars, local, to_spark, walk
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "bars_daily", "bars_hourly_events", "validation_report", "clean_bars", "cleaning_log",
    "feature_matrix", "future_corr", "target_regression", "split_summary", "signal_summary",
    "trade_log", "benchmark_comparison", "regime_performance", "sweep_cost", "sweep_period",
    "fold_table", "log_backfill", "log_scorecard", "verdict",
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 45
    assert df.columns == ["symbol", "metric", "strategy", "buy_and_hold", "difference"]


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SMALL) == []


def test_target_alignment(spark):
    bars = to_spark(spark, linear_bars(10))
    out = local(make_target(bars, 2), "date")
    close = out["close"]
    np.testing.assert_allclose(out["target"][:8], close.shift(-2)[:8] / close[:8] - 1)
    assert out["target"][8:].isna().all()
    with pytest.raises(ValueError):
        make_target(bars, 0)


def test_split_checks(spark):
    bars = to_spark(spark, linear_bars(60))
    check_split(chronological_split(bars, "2024-01-31", "2024-02-29"))
    with pytest.raises(ValueError, match="empty"):
        check_split(chronological_split(bars, "2024-01-31", "2030-01-01"))
    with pytest.raises(ValueError):
        chronological_split(bars, "2024-03-01", "2024-02-01")


def test_causal_labels_do_not_change_with_the_future(spark):
    pdf = walk(300)
    full = local(volatility_regime(to_spark(spark, pdf), causal=True), "date")
    head = local(volatility_regime(to_spark(spark, pdf.iloc[:200]), causal=True), "date")
    assert list(full["vol_regime"][:200].fillna("")) == list(head["vol_regime"].fillna(""))


def test_metrics_on_tied_and_constant_predictions(spark):
    rows = [("A", 0.01, 1.0), ("A", -0.02, 1.0), ("A", 0.03, 2.0), ("A", 0.0, None), ("B", 1.0, 5.0), ("B", 2.0, 5.0), ("B", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, target double, prediction double")
    got = {r["symbol"]: r for r in regression_metrics(df).collect()}
    rank = pd.Series([0.01, -0.02, 0.03]).rank().corr(pd.Series([1.0, 1.0, 2.0]).rank())
    assert np.isclose(got["A"]["information_coefficient"], rank)
    assert got["A"]["n"] == 3
    assert got["B"]["information_coefficient"] is None
    flat = classification_metrics(df.where("symbol = 'B'"), probability="prediction").first()
    assert flat["roc_auc"] is None and flat["recall"] == 1.0
