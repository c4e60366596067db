"""Daily predictions, logged before and scored after their outcome is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.config import StudySpec
from barloom.functions.asof import asof_join
from barloom.functions.columns import mean_when
from barloom.functions.durable import checkpointed
from barloom.functions.windows import by_date, first_n
from barloom.operators.cleaning import clean
from barloom.operators.features import build_features, look_back
from barloom.operators.models import load_model, predict
from barloom.operators.signals import signal_of
from barloom.operators.target import realised_returns
from barloom.sources.logs import (
    LOG_KEY,
    append_outcomes,
    append_predictions,
    batch_predictions,
    read_log,
)

#: The market's zone and hour of close; bars of the tail, least bars of a symbol, largest believable daily return.
MARKET_TZ = "America/New_York"
CLOSE_HOUR = 16
TAIL_BARS = 400
MIN_BARS = 100
SANITY_BOUND = 0.10

#: Days before an open prediction from which bars are read, so that its own bar is among them.
SLACK_DAYS = 30


def bar_is_final(bar_date: str | Column, now: str | Column) -> Column:
    """Whether the session of a bar was over at ``now`` (a UTC timestamp).

    Earlier market days are final, today's only after the close, later ones
    never.  ``now`` is a parameter so that runs can be replayed.
    """
    bar = F.col(bar_date) if isinstance(bar_date, str) else bar_date
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    local = F.from_utc_timestamp(moment, MARKET_TZ)
    today = F.to_date(local)
    return F.when(bar == today, F.hour(local) >= CLOSE_HOUR).otherwise(bar < today)


def unlogged(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates whose (symbol, bar_date, model) is not in the log yet."""
    return candidates.join(log.select(*LOG_KEY), list(LOG_KEY), "left_anti")


def with_direction(log: DataFrame) -> DataFrame:
    s = F.col("signal")
    return log.withColumn(
        "direction", F.when(s > 0, "LONG").when(s < 0, "SHORT").otherwise("FLAT")
    )


def latest_features(cleaned: DataFrame, spec: StudySpec) -> DataFrame:
    """Feature row of the newest complete bar per symbol, from a bounded tail.

    Symbols with under 100 bars have no row.  The tail restarts the recursive
    indicators, which moves them by less than rounding after 400 bars.
    """
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("date"))
    tail = (
        cleaned.withColumns(
            {
                "__age": F.row_number().over(newest_first),
                "__bars": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
            }
        )
        .where((F.col("__age") <= TAIL_BARS) & (F.col("__bars") >= MIN_BARS))
        .drop("__age", "__bars")
    )
    return first_n(build_features(tail, spec.features), 1, ["symbol"], F.desc("date"))


def recent(raw: DataFrame, log: DataFrame, spec: StudySpec) -> DataFrame:
    """The raw rows that a daily run reads: the tail of each symbol and what open predictions need.

    The dates alone (two columns) tell where the tail of a symbol begins: the
    bars of the feature tail, the look-back of the features before it, and as
    many again as slack for bars that cleaning drops.
    """
    bars = 2 * (TAIL_BARS + look_back(spec.features))
    dates = raw.select("symbol", F.to_date("date").alias("date")).distinct()
    tail = first_n(dates, bars, ["symbol"], F.desc("date")).groupBy("symbol").agg(F.min("date").alias("__tail"))
    open_since = (
        log.where(F.col("realised_return").isNull())
        .groupBy("symbol")
        .agg(F.date_sub(F.min("bar_date"), SLACK_DAYS).alias("__open"))
    )
    since = tail.join(open_since, "symbol", "left").select(
        "symbol", F.least("__tail", "__open").alias("__since")
    )
    return raw.join(since, "symbol").where(F.to_date("date") >= F.col("__since")).drop("__since")


def recent_bars(raw: DataFrame, log: DataFrame, spec: StudySpec) -> DataFrame:
    """Cleaned bars of what ``recent`` reads, with the whole history of symbols it is too short for.

    Cleaning may drop most of the raw dates read.  A symbol that is then left
    with fewer bars than the feature tail and its look-back, although it has
    older raw rows, is cleaned from its first row on; the others are not read
    again.
    """
    need = TAIL_BARS + look_back(spec.features)
    rows = recent(raw, log, spec)
    cleaned = checkpointed(clean(rows))
    kept = cleaned.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    since = rows.groupBy("symbol").agg(F.min(F.to_date("date")).alias("from"))
    wanting = since.join(kept, "symbol", "left").where(F.coalesce("n", F.lit(0)) < need)
    older = raw.join(wanting.select("symbol", "from"), "symbol").where(F.to_date("date") < F.col("from"))
    short = checkpointed(older.select("symbol").distinct())
    if short.isEmpty():
        return cleaned
    again = clean(raw.join(short, "symbol", "left_semi"))
    return checkpointed(cleaned.join(short, "symbol", "left_anti").unionByName(again))


def predict_latest(
    cleaned: DataFrame, model: PipelineModel, spec: StudySpec, logged_at: str
) -> DataFrame:
    """One log-shaped row per symbol.

    ``refused`` marks predictions that are not finite or beyond ten percent,
    which no daily return forecast should be.
    """
    scored = predict(model, latest_features(cleaned, spec))
    p = F.col("prediction")
    refused = p.isNull() | F.isnan(p) | (F.abs(p) > SANITY_BOUND)
    return scored.select(
        F.col("date").alias("bar_date"),
        "symbol",
        F.lit(spec.model).alias("model"),
        F.lit(spec.fingerprint()).alias("fingerprint"),
        "prediction",
        signal_of("prediction", spec.threshold, spec.allow_short).alias("signal"),
        F.lit(logged_at).cast("timestamp").alias("logged_at"),
        refused.alias("refused"),
    )


def next_bars(log: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """For each logged bar date: the next bar that exists, and its return.

    Log dates need not be bar dates.  There is no range join, holidays need no
    calendar, and a symbol with most bars is dealt over stretches of time.
    """
    moves = realised_returns(bars, keys=keys).select(*keys, F.col("date").alias("bar_date"), "asset_return")
    marks = log.select(*keys, "bar_date").distinct()
    found = asof_join(marks, moves, keys, "bar_date", forward=True, exact=False, name="__next")
    return found.where(F.col("__next").isNotNull()).select(
        *keys,
        "bar_date",
        F.col("__next.bar_date").alias("target_date"),
        F.col("__next.asset_return").alias("realised_return"),
    )


def outcomes(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome rows for unscored predictions whose next bar exists by now."""
    open_rows = log.where(F.col("realised_return").isNull()).select(
        *LOG_KEY, "signal"
    )
    agrees = F.signum("signal") == F.signum("realised_return")
    return open_rows.join(next_bars(open_rows, bars), ["symbol", "bar_date"]).select(
        "bar_date",
        "symbol",
        "model",
        "target_date",
        "realised_return",
        F.when(F.col("signal") == 0, "flat")
        .when(agrees, "True")
        .otherwise("False")
        .alias("correct"),
    )


def backfill_outcomes(log: DataFrame, bars: DataFrame) -> DataFrame:
    """The log with newly known outcomes filled in; scored rows are untouched."""
    fresh = outcomes(log, bars).select(
        *LOG_KEY,
        *[F.col(c).alias(f"__{c}") for c in ("target_date", "realised_return", "correct")],
    )
    return (
        log.join(fresh, list(LOG_KEY), "left")
        .withColumns(
            {
                c: F.coalesce(c, f"__{c}")
                for c in ("target_date", "realised_return", "correct")
            }
        )
        .select(*log.columns)
    )


def scorecard(log: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Live track record per key, gross of costs."""
    known = F.col("realised_return").isNotNull()
    called = known & F.col("correct").isin("True", "False")
    r = F.when(known, F.col("realised_return"))
    date = F.when(known, F.col("bar_date"))
    some = F.count_if(known) > 0
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(known).alias("n_scored"),
        F.count_if(called).alias("n_directional"),
        mean_when(F.when(called, F.col("correct") == "True")).alias("hit_rate"),
        F.when(some, F.product(1 + F.col("signal") * r) - 1).alias("strategy_return"),
        F.when(some, F.product(1 + r) - 1).alias("buy_and_hold_return"),
        F.avg(F.when(known, F.col("prediction"))).alias("mean_prediction"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def live_equity(log: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """Running growth of following the signals, over scored rows."""
    w = by_date(*keys, order="bar_date").rowsBetween(Window.unboundedPreceding, 0)
    scored = log.where(F.col("realised_return").isNotNull())
    return scored.withColumns(
        {
            "strategy_equity": F.product(1 + F.col("signal") * F.col("realised_return")).over(w),
            "benchmark_equity": F.product(1 + F.col("realised_return")).over(w),
        }
    )


def run_daily(
    spark: SparkSession,
    raw: DataFrame,
    model_folder: str,
    log_root: str,
    batch: int,
    now: str,
    spec: StudySpec,
) -> DataFrame:
    """Score what can be scored, then predict what is new and final.

    Safe to repeat: a batch reads the log as it stood before it and overwrites
    only its own files; outcomes are looked up before predictions are made, and
    a key already in the log is skipped.
    Reads only the tail of each symbol.  Returns the status of every symbol.
    """
    log = read_log(spark, log_root, before=batch)
    cleaned = recent_bars(raw, log, spec)
    append_outcomes(outcomes(log, cleaned), log_root, batch)

    made = checkpointed(predict_latest(cleaned, load_model(model_folder), spec, now))
    fresh = unlogged(made, log).where(bar_is_final("bar_date", now) & ~F.col("refused"))
    append_predictions(fresh, log_root, batch)

    ours = batch_predictions(spark, log_root, batch)
    marks = ours.select(*LOG_KEY, F.lit(True).alias("__new"))
    earlier = log.select(*LOG_KEY, F.lit(True).alias("__old"))
    status = (
        F.when(F.col("__new"), "predicted")
        .when(F.col("__old"), "no_new_bar")
        .when(~bar_is_final("bar_date", now), "bar_not_final")
        .when(F.col("refused"), "refused")
    )
    told = (
        made.join(marks, list(LOG_KEY), "left")
        .join(earlier, list(LOG_KEY), "left")
        .select("symbol", "bar_date", "model", status.alias("status"), "prediction", "signal")
    )
    # a symbol without a complete feature row has too few bars
    short = (
        raw.groupBy("symbol")
        .agg(F.max(F.to_date("date")).alias("bar_date"))
        .join(told, "symbol", "left_anti")
        .select("symbol", "bar_date", F.lit(spec.model).alias("model"), F.lit("too_short").alias("status"))
    )
    return told.unionByName(short, allowMissingColumns=True)
