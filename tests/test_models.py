import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.durable import ensure_checkpoint_dir
from barloom.operators.linear import fit_linear, linear_importance, predict_linear
from barloom.operators.models import (
    feature_importance,
    fit_model,
    load_model,
    predict,
    save_model,
)
from barloom.operators.walkforward import make_folds, walk_forward, with_folds
from tests.frames import local

NAMES = [f"f{i}" for i in range(6)]
SCHEMA = "symbol string, date date, " + ", ".join(f"{n} double" for n in NAMES) + ", target double"


def matrix(n=400, seed=3, symbol="AAA"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 2, 3, 1, 1, 10] + [0, 1, 0, 0, 5, 0]
    y = 0.5 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(0, 0.1, n)
    out = pd.DataFrame(x, columns=NAMES)
    out.insert(0, "date", pd.bdate_range("2020-01-01", periods=n).date)
    out.insert(0, "symbol", symbol)
    return out.assign(target=y)


def ridge_closed_form(train, test, alpha):
    x, y = train[NAMES].to_numpy(), train["target"].to_numpy()
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(6), z.T @ (y - y.mean()))
    return (test[NAMES].to_numpy() - mean) / sd @ b + y.mean()


@pytest.fixture(scope="module")
def panel():
    return pd.concat([matrix(), matrix(380, seed=4, symbol="BBB")], ignore_index=True)


def as_frame(spark, pdf):
    return spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], SCHEMA)


@pytest.mark.parametrize("name, alpha", [("linear", 0.0), ("ridge", 25.0)])
def test_pooled_linear_models_match_the_closed_form(spark, name, alpha):
    pdf = matrix()
    params = {"alpha": alpha} if name == "ridge" else None
    df = as_frame(spark, pdf)
    got = local(predict(fit_model(df, NAMES, name, params), df), "date")["prediction"]
    np.testing.assert_allclose(got, ridge_closed_form(pdf, pdf, alpha), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("alpha", [None, 25.0])
def test_per_symbol_linear_models_match_the_closed_form(spark, panel, alpha):
    df = as_frame(spark, panel)
    got = local(predict_linear(df, fit_linear(df, NAMES, alpha=alpha), NAMES), "symbol", "date")
    for symbol, part in panel.groupby("symbol"):
        want = ridge_closed_form(part, part, alpha or 0.0)
        np.testing.assert_allclose(got[got.symbol == symbol]["prediction"], want, rtol=1e-8, atol=1e-10)


def test_dependent_features_do_not_change_predictions(spark):
    pdf = matrix()
    pdf["f5"] = pdf["f0"] - pdf["f1"]
    df = as_frame(spark, pdf)
    got = local(predict_linear(df, fit_linear(df, NAMES), NAMES), "date")["prediction"]
    x = np.c_[np.ones(len(pdf)), pdf[NAMES].to_numpy()]
    want = x @ np.linalg.lstsq(x, pdf["target"], rcond=None)[0]
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-10)


def test_importance_sums_to_one_and_ranks(spark, panel):
    df = as_frame(spark, panel)
    weights = local(linear_importance(fit_linear(df, NAMES), NAMES))
    assert np.allclose(weights.groupby("symbol")["importance"].sum(), 1)
    top = weights.sort_values("importance").groupby("symbol").tail(2)
    assert set(top["feature"]) == {"f0", "f1"}


def test_tree_models_learn_and_survive_a_round_trip(spark, tmp_path):
    pdf = matrix()
    df = as_frame(spark, pdf)
    for name, params in (
        ("random_forest", {"trees": 20, "min_leaf": 5}),
        ("boosted", {"rounds": 8, "min_leaf": 5, "learning_rate": 0.3}),
    ):
        model = fit_model(df, NAMES, name, params)
        weights = local(feature_importance(model, spark))
        assert np.isclose(weights["importance"].sum(), 1)
        assert set(weights["feature"][:2]) == {"f0", "f1"}
        again = load_model(save_model(model, str(tmp_path / name)))
        a, b = (local(predict(m, df), "date")["prediction"] for m in (model, again))
        np.testing.assert_array_equal(a, b)
        assert np.corrcoef(a, pdf["target"])[0, 1] > 0.7


def test_fit_refuses_bad_input(spark):
    df = as_frame(spark, matrix(50))
    with pytest.raises(ValueError):
        fit_model(df.where("false"), NAMES, "linear")
    with pytest.raises(ValueError):
        fit_model(df, NAMES, "unknown")
    with pytest.raises(ValueError):
        predict(fit_model(df, NAMES, "linear"), df.drop("f0"))


def test_classification_gives_probabilities(spark):
    df = as_frame(spark, matrix()).withColumn("target", (F.col("target") > 0).cast("double"))
    got = local(predict(fit_model(df, NAMES, "linear", task="classification"), df), "date")
    assert got["probability"].between(0, 1).all()
    assert ((got["probability"] > 0.5) == (got["prediction"] > 0.5)).all()


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_walk_forward_against_brute_force(spark, panel, mode):
    df = as_frame(spark, panel)
    out, _ = walk_forward(df, NAMES, "ridge", {"alpha": 2.0}, n_folds=4, mode=mode, min_train=100)
    got = local(out, "symbol", "date")
    for symbol, part in panel.groupby("symbol"):
        edges = np.linspace(100, len(part), 5).astype(int)
        want = []
        for a, b in zip(edges, edges[1:]):
            first = 0 if mode == "expanding" else a - 100
            want.append(ridge_closed_form(part.iloc[first:a], part.iloc[a:b], 2.0))
        mine = got[got.symbol == symbol]
        assert len(mine) == len(part) - 100
        np.testing.assert_allclose(mine["prediction"], np.concatenate(want), rtol=1e-8, atol=1e-10)


def test_fold_geometry(spark, panel):
    table = local(make_folds(as_frame(spark, panel), 4, "rolling", 100), "symbol", "fold")
    assert (table["n_train"] == 100).all()
    assert (table["train_end"] < table["test_start"]).all()
    with pytest.raises(ValueError):
        with_folds(as_frame(spark, panel), 0)
    assert make_folds(as_frame(spark, panel), 4, "expanding", 5000).isEmpty()


def test_pooled_walk_forward_covers_the_tested_dates(spark):
    df = as_frame(spark, matrix(160))
    out, importance = walk_forward(
        df, NAMES, "random_forest", {"trees": 5, "min_leaf": 5}, n_folds=2, min_train=100
    )
    assert out.count() == 60
    assert importance.count() == 12


def test_checkpoint_folder_is_the_sessions(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
