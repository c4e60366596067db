"""Prediction and experiment logs, and plain CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.panel_store import _exists

LOG_SCHEMA = (
    "bar_date date, target_date date, symbol string, model string, fingerprint string, "
    "prediction double, signal double, realised_return double, correct string, "
    "logged_at timestamp"
)
PREDICTIONS = (
    "bar_date date, symbol string, model string, fingerprint string, prediction double, "
    "signal double, logged_at timestamp"
)
OUTCOMES = (
    "bar_date date, symbol string, model string, target_date date, realised_return double, "
    "correct string"
)
LOG_KEY = ("symbol", "bar_date", "model")


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def coerce_log(df: DataFrame) -> DataFrame:
    """Any log-like frame (say a CSV of strings) on the declared types.

    Absent columns become missing; empty text is missing; text that is no
    number or date is missing.
    """
    out = []
    for part in LOG_SCHEMA.split(", "):
        name, kind = part.split(" ")
        if name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        text = F.trim(F.col(name).cast("string"))
        known = F.when((text != "") & (F.lower(text) != "nan"), text)
        out.append((known if kind == "string" else known.try_cast(kind)).alias(name))
    return df.select(*out)


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return empty_log(spark)
    return coerce_log(spark.read.csv(path, header=True))


def _part(
    spark: SparkSession, path: str, schema: str, before: int | None, only: int | None
) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if only is not None:
        rows = rows.where(F.col("batch") == only)
    return rows.drop("batch")


def read_log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The prediction log, optionally as it stood before a batch.

    Predictions and their outcomes are two append-only tables; a stored row is
    never rewritten.
    """
    root = root.rstrip("/")
    made = _part(spark, f"{root}/predictions", PREDICTIONS, before, None)
    scored = _part(spark, f"{root}/outcomes", OUTCOMES, before, None)
    return made.join(scored, list(LOG_KEY), "left").select(
        *[p.split(" ")[0] for p in LOG_SCHEMA.split(", ")]
    )


def batch_predictions(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """What one batch predicted."""
    return _part(spark, f"{root.rstrip('/')}/predictions", PREDICTIONS, None, batch)


def append_predictions(rows: DataFrame, root: str, batch: int) -> None:
    _append(rows, PREDICTIONS, f"{root.rstrip('/')}/predictions/batch={batch}")


def append_outcomes(rows: DataFrame, root: str, batch: int) -> None:
    _append(rows, OUTCOMES, f"{root.rstrip('/')}/outcomes/batch={batch}")


def _append(rows: DataFrame, schema: str, path: str) -> None:
    """A batch owns its directory, so repeating it cannot duplicate rows."""
    names = [p.split(" ")[0] for p in schema.split(", ")]
    rows.select(*names).write.mode("overwrite").parquet(path)


#: Settings that an experiment row carries.
SETTINGS = (
    "model", "kind", "horizon", "train_end", "valid_end", "threshold", "allow_short", "cost_bps",
    "slippage_bps", "initial_capital", "seed", "risk_free_rate",
)


def experiment_row(spec, accuracy: DataFrame, performance: DataFrame) -> DataFrame:
    """One row per symbol of a run: settings, ``model_*`` and ``strategy_*`` numbers."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("symbol", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "symbol"])

    return named(accuracy, "model_").join(named(performance, "strategy_"), "symbol").select(
        F.lit(spec.fingerprint()).alias("run"), *[F.lit(getattr(spec, c)).alias(c) for c in SETTINGS], "*"
    )


def log_experiment(row: DataFrame, path: str, run: str) -> None:
    """Store one run; repeating a run replaces it, and columns may differ between runs."""
    row.drop("run").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    """Any per-bar frame or log as CSV files with a header."""
    df.write.mode("overwrite").csv(path, header=True)
    return path
