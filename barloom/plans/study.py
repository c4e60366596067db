"""The study end to end, and each of its stages as a function of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import StudySpec
from barloom.functions.durable import checkpointed
from barloom.operators import stress
from barloom.operators.backtest import align, entered, run_backtest, trade_log
from barloom.operators.cleaning import clean, cleaning_log, mark_cleaning
from barloom.operators.evaluate import evaluate, sanity_flags
from barloom.operators.feature_stats import future_return_correlation
from barloom.operators.features import feature_names
from barloom.operators.linear import fit_linear, linear_importance, predict_linear
from barloom.operators.metrics import compare_to_benchmark, performance, trade_statistics
from barloom.operators.models import (
    DEFAULTS,
    MODELS,
    feature_importance,
    fit_many,
    fit_model,
    predict,
    stack_predictions,
)
from barloom.operators.quality import validate
from barloom.operators.regimes import regime_report
from barloom.operators.report import correlation_headline, report_sections, report_text, verdict
from barloom.operators.signals import generate_signals
from barloom.operators.target import build_dataset, check_split, realised_returns, split_summary
from barloom.operators.walkforward import (
    fold_bounds,
    fold_table,
    make_folds,
    stability,
    walk_forward,
    with_date_folds,
)
from barloom.sources.raw_bars import describe


def fetch(raw: DataFrame) -> dict[str, DataFrame]:
    """Validation report, cleaned bars, cleaning log and headline statistics."""
    marked = mark_cleaning(raw)
    cleaned = clean(raw)
    return {
        "issues": validate(raw),
        "cleaned": cleaned,
        "cleaning_log": cleaning_log(marked),
        "summary": describe(cleaned),
    }


def prepare(cleaned: DataFrame, spec: StudySpec, durable: bool = True) -> DataFrame:
    """The labelled, split feature panel.

    Fits and sweeps read it many times, so it is written to the checkpoint
    folder once instead of being recomputed for each.  A symbol that lacks a
    part of the split is an error.
    """
    data = build_dataset(cleaned, spec)
    data = checkpointed(data) if durable else data
    check_split(data)
    return data


@dataclass(frozen=True)
class Trained:
    predictions: DataFrame
    importance: DataFrame
    model: PipelineModel | None = None


def train(
    data: DataFrame,
    spec: StudySpec,
    name: str | None = None,
    per_symbol: bool = False,
    params: Mapping | None = None,
) -> Trained:
    """Fit on the training part; predict every part in one pass.

    ``per_symbol`` fits linear models for all symbols at once; otherwise one
    Spark ML model is fitted on the pooled rows.
    """
    name = name or spec.model
    features = feature_names(spec.features)
    rows = data.where(F.col("split") == "train")
    settings = {**spec.model_params.get(name, {}), **(params or {})}
    if per_symbol:
        if name not in ("linear", "ridge") or spec.kind != "regression":
            raise ValueError("per-symbol fits cover linear and ridge regression")
        alpha = {**DEFAULTS[name], **settings}.get("alpha") if name == "ridge" else None
        fitted = fit_linear(rows, features, alpha=alpha)
        return Trained(
            predict_linear(data, fitted, features), linear_importance(fitted, features)
        )
    model = fit_model(rows, features, name, settings, spec.seed, spec.kind)
    importance = feature_importance(model, data.sparkSession)
    return Trained(predict(model, data), importance, model)


def backtest(
    predictions: DataFrame,
    spec: StudySpec,
    part: str = "test",
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One part's predictions as a backtest; returns restart with the part."""
    rows = realised_returns(predictions.where(F.col("split") == part), keys=keys)
    signalled = generate_signals(rows, "prediction", spec.threshold, spec.allow_short)
    return run_backtest(signalled, keys, spec.cost_bps, spec.slippage_bps)


def backtest_signals(
    bars: DataFrame, signals: DataFrame, spec: StudySpec, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """A backtest of signals from elsewhere ``(keys, date, signal)``, on the dates that bars and signals share."""
    both = align(realised_returns(bars, keys=keys), signals.select(*keys, "date", "signal"), keys)
    return run_backtest(both, keys, spec.cost_bps, spec.slippage_bps)


def backtest_report(result: DataFrame, spec: StudySpec) -> tuple[DataFrame, DataFrame]:
    """Sections and texts of the report on a finished backtest alone, per symbol."""
    comparison = compare_to_benchmark(result, rf=spec.risk_free_rate)
    sections = report_sections({
        "verdict": verdict(comparison),
        "comparison": comparison,
        "trade_statistics": trade_statistics(trade_log(result)),
    })
    return sections, report_text(sections)


def model_metrics(
    predictions: DataFrame, spec: StudySpec, keys: Sequence[str] = ("symbol", "split")
) -> DataFrame:
    score = "probability" if "probability" in predictions.columns else None
    return evaluate(predictions, spec.kind, keys=keys, probability=score)


def compare_models(
    data: DataFrame,
    spec: StudySpec,
    names: Sequence[str] = MODELS,
    part: str = "test",
    params: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Every model on identical rows, and buy-and-hold, one row each per symbol."""
    params = params or {}
    features = feature_names(spec.features)
    rows = data.where(F.col("split") == "train")
    settings = {n: {**spec.model_params.get(n, {}), **params.get(n, {})} for n in names}
    fitted = fit_many(
        {
            n: (lambda n=n: fit_model(rows, features, n, settings[n], spec.seed, spec.kind))
            for n in names
        }
    )
    tested = data.where(F.col("split") == part)
    return comparison_table(stack_predictions(fitted, tested, "model"), spec, part)


def comparison_table(stacked: DataFrame, spec: StudySpec, part: str = "test") -> DataFrame:
    """Accuracy and backtest of predictions told apart by ``model``."""
    keys = ["symbol", "model"]
    accuracy = evaluate(stacked, keys=keys).select(
        *keys, "rmse", "mae", "r2", "directional_accuracy", "information_coefficient"
    )
    result = backtest(stacked, spec, part, keys).withColumn("__entered", entered(keys))
    scored = performance(
        result,
        {"strategy": "strategy_return", "benchmark": "asset_return"},
        keys,
        rf=spec.risk_free_rate,
        positions={"strategy": "position"},
        extra={"n_trades": F.count_if("__entered")},
    )
    stats = ("total_return", "cagr", "sharpe_ratio", "max_drawdown", "n_trades", "exposure")
    own = scored.where(F.col("series") == "strategy").select(*keys, *stats)
    # Every model carries the same market rows, so the first model's stand for all.
    hold = (
        scored.where(F.col("series") == "benchmark")
        .groupBy("symbol")
        .agg(*[F.min_by(c, "model").alias(c) for c in stats[:4]])
        .withColumns(
            {
                "model": F.lit("buy_and_hold"),
                "n_trades": F.lit(1).cast("bigint"),
                "exposure": F.lit(1.0),
            }
        )
    )
    return accuracy.join(own, keys).unionByName(hold, allowMissingColumns=True)


def seed_predictions(
    data: DataFrame,
    spec: StudySpec,
    name: str,
    seeds: Sequence[int] | None = None,
    params: Mapping | None = None,
) -> DataFrame:
    """Test rows with ``asset_return``, once per seed (all of the settings) of a refitted model."""
    seeds = spec.seed_grid if seeds is None else seeds
    features = feature_names(spec.features)
    rows = data.where(F.col("split") == "train")
    models = fit_many(
        {s: (lambda s=s: fit_model(rows, features, name, params, s, spec.kind)) for s in seeds}
    )
    tested = realised_returns(data.where(F.col("split") == "test"), keys=["symbol"])
    return stack_predictions(models, tested, "seed")


def sweeps(test_rows: DataFrame, spec: StudySpec) -> dict[str, DataFrame]:
    """Cost, threshold and period sweeps of rows with returns and predictions."""
    common = {"allow_short": spec.allow_short}
    costs = {"cost_bps": spec.cost_bps, "slippage_bps": spec.slippage_bps}
    return {
        "cost": stress.sweep_costs(
            test_rows, spec.cost_grid, threshold=spec.threshold, **common
        ),
        "threshold": stress.sweep_thresholds(test_rows, spec.threshold_grid, **costs, **common),
        "period": stress.sweep_periods(
            test_rows, 4, threshold=spec.threshold, **costs, **common
        ),
    }


def run_full_study(
    raw: DataFrame,
    spec: StudySpec,
    name: str | None = None,
    per_symbol: bool = False,
    include_walk_forward: bool = True,
    include_regimes: bool = True,
    include_stress: bool = True,
    params: Mapping | None = None,
) -> dict[str, DataFrame]:
    """Everything for every symbol of the panel: tables, then report sections."""
    name = name or spec.model
    out = fetch(raw)
    data = prepare(out["cleaned"], spec)
    trained = train(data, spec, name, per_symbol, params)
    result = backtest(trained.predictions, spec)
    metrics = model_metrics(trained.predictions, spec)
    comparison = compare_to_benchmark(result, rf=spec.risk_free_rate)
    corr = future_return_correlation(data)
    symbols = data.select("symbol").distinct()
    importance = trained.importance
    if "symbol" not in importance.columns:
        # A pooled model has one set of weights, 43 rows, for all symbols.
        importance = symbols.select(
            "symbol",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(r.feature).alias("feature"), F.lit(r.importance).alias("importance"))
                        for r in importance.collect()
                    ]
                )
            ).alias("i"),
        ).select("symbol", "i.*")
    trades = trade_log(result)
    if spec.kind == "regression":
        metrics = sanity_flags(metrics)
    tables = {
        "verdict": verdict(comparison),
        "dataset": out["summary"],
        "splits": split_summary(data),
        "model_metrics": metrics,
        "importance": importance,
        "correlation": correlation_headline(corr),
        "comparison": comparison,
        "trade_statistics": trade_statistics(trades),
    }
    out |= {"data": data, "predictions": trained.predictions, "backtest": result, "trades": trades}

    if include_walk_forward and spec.kind == "regression":
        features = feature_names(spec.features)
        folds = {"n_folds": spec.n_folds, "mode": spec.fold_mode, "min_train": spec.min_train}
        stitched, _ = walk_forward(data, features, name, params, seed=spec.seed, **folds)
        if name in ("linear", "ridge"):
            bounds = make_folds(data, **folds)
        else:
            bounds = fold_bounds(with_date_folds(data, **folds))
        table = fold_table(stitched, bounds)
        tables |= {"walk_forward": table, "stability": stability(table)}
        out["walk_forward"] = stitched
    if include_regimes:
        tables["regimes"] = regime_report(result)
    if include_stress:
        swept = sweeps(result.drop("signal"), spec)
        tables |= {f"{k}_sweep": v for k, v in swept.items()}
        robust = stress.robustness_summary(swept)
        tables |= {"robustness": robust, "stress_verdict": stress.stress_verdict(robust)}
    sections = report_sections(tables)
    return {**out, **tables, "sections": sections, "reports": report_text(sections)}
