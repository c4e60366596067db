"""Cleaning and corporate-action adjustment.  The step order is semantic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import is_infinite, ratio
from barloom.functions.windows import by_date

PRICES = ("open", "high", "low", "close", "adj_close")
FIELDS = (*PRICES, "volume")
TOLERANCE = 1e-6


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def count_true(conditions: Sequence[Column]) -> Column:
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in conditions]
    return reduce(lambda a, b: a + b, flags)


def body_outside_range() -> Column:
    """Open or close beyond [low, high] by more than the tolerance."""
    above = [F.col(c) > F.col("high") + TOLERANCE for c in ("open", "close")]
    below = [F.col(c) < F.col("low") - TOLERANCE for c in ("open", "close")]
    return any_of(above + below)


def keep_latest(
    df: DataFrame, seq: str = "ingest_seq", fields: Sequence[str] = FIELDS
) -> DataFrame:
    """One row per (symbol, date): the last to arrive, plus the copy count.

    ``max_by`` combines before the shuffle, so a date with any number of
    copies moves one row per task.  ``seq`` must be unique within a symbol.
    """
    return df.groupBy("symbol", "date").agg(
        *[F.max_by(c, seq).alias(c) for c in fields],
        F.count(F.lit(1)).alias("copies"),
    )


def mark_cleaning(
    df: DataFrame,
    max_ffill: int = 3,
    drop_zero_volume: bool = False,
    seq: str | None = "ingest_seq",
) -> DataFrame:
    """Apply every cleaning step and keep a per-row record of what it did.

    Adds ``copies``, ``n_infinite``, ``n_nonpositive``, ``negative_volume``,
    ``n_filled`` and ``dropped`` (NULL for a surviving row, else the reason).
    The cleaned panel and the cleaning log are both plain reads of this frame.
    """
    bars = keep_latest(df, seq) if seq else df.withColumn("copies", F.lit(1).cast("bigint"))

    infinite = {c: is_infinite(c) for c in FIELDS}
    bars = bars.withColumn("n_infinite", count_true(list(infinite.values())))
    bars = bars.withColumns(
        {c: F.when(~bad, F.col(c)) for c, bad in infinite.items()}
    )

    bars = bars.withColumns(
        {
            "n_nonpositive": count_true([F.col(c) <= 0 for c in PRICES]),
            "negative_volume": count_true([F.col("volume") < 0]),
        }
    )
    bars = bars.withColumns(
        {
            **{c: F.when(F.col(c) > 0, F.col(c)) for c in PRICES},
            "volume": F.when(F.col("volume") >= 0, F.col("volume")),
        }
    )

    # A limited forward fill reaches back max_ffill rows and no further; in a
    # longer gap the first max_ffill rows are therefore still filled.
    recent = by_date("symbol").rowsBetween(-max_ffill, 0)
    bars = bars.withColumn("__gaps", count_true([F.col(c).isNull() for c in PRICES]))
    bars = bars.withColumns(
        {c: F.last(c, ignorenulls=True).over(recent) for c in PRICES}
    )
    still = count_true([F.col(c).isNull() for c in PRICES])
    reason = (
        F.when(any_of([F.col(c).isNull() for c in FIELDS]), "missing")
        .when((F.col("high") < F.col("low")) | body_outside_range(), "impossible")
    )
    if drop_zero_volume:
        reason = reason.when(F.col("volume") == 0, "zero_volume")
    return bars.withColumns(
        {"n_filled": F.col("__gaps") - still, "dropped": reason}
    ).drop("__gaps")


def clean(df: DataFrame, **options) -> DataFrame:
    """The cleaned panel: one valid bar per (symbol, date)."""
    return (
        mark_cleaning(df, **options)
        .where(F.col("dropped").isNull())
        .select("symbol", "date", *FIELDS)
    )


def cleaning_log(marked: DataFrame) -> DataFrame:
    """What cleaning changed, per symbol, in one pass over the marked frame."""
    def dropped(reason: str) -> Column:
        return F.count_if(F.col("dropped") == reason)

    return marked.groupBy("symbol").agg(
        F.sum("copies").alias("rows_before"),
        F.count_if(F.col("dropped").isNull()).alias("rows_after"),
        F.sum(F.col("copies") - 1).alias("duplicates_dropped"),
        F.sum("n_infinite").alias("infinite_to_missing"),
        F.sum("n_nonpositive").alias("nonpositive_to_missing"),
        F.sum("negative_volume").alias("negative_volume_to_missing"),
        F.sum("n_filled").alias("prices_filled"),
        dropped("missing").alias("missing_dropped"),
        dropped("impossible").alias("impossible_dropped"),
        dropped("zero_volume").alias("zero_volume_dropped"),
    )


def adjust_ohlc(df: DataFrame) -> DataFrame:
    """Put open/high/low on the basis of ``adj_close``; volume is untouched."""
    factor = ratio("adj_close", "close")
    return df.withColumns(
        {
            **{c: F.col(c) * factor for c in ("open", "high", "low")},
            "close": F.col("adj_close"),
        }
    )
