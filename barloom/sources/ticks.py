"""Ticks to OHLCV bars: the step whose cost grows with the raw data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices are carried as whole millionths, so bars are exact and order-free.
TICKS_PER_UNIT = 1_000_000
_PRICE_SLOT = 10**18
_PRICE_SHIFT = 4 * 10**17

#: Largest price, either way, that a bar can hold.
MAX_PRICE = 4 * 10**11 - 1

BAR_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def _bucket(ts: Column, every: str) -> Column:
    if every == "hour":
        return F.date_trunc("hour", ts)
    day = F.to_date(ts)
    return day if every == "day" else F.trunc(day, every)


def bar_aggregates() -> list[Column]:
    """What one bar keeps of its ticks; shared by batch and stream.

    First and last price come from the minimum and maximum of one decimal,
    ``seq`` followed by the price shifted to be positive.  All buffers are then
    fixed width, which keeps the aggregation a hash aggregate with map-side
    combine: what is shuffled is one row per (symbol, interval) and task, no
    matter how many ticks a hot symbol has.  ``min_by`` over a struct key would
    sort all ticks first.
    """
    micros = F.round(F.col("price") * F.lit(float(TICKS_PER_UNIT))).cast("bigint")
    slot = F.lit(_PRICE_SLOT).cast("decimal(19,0)")
    ranked = F.col("seq").cast("decimal(19,0)") * slot + (
        micros.cast("decimal(19,0)") + F.lit(_PRICE_SHIFT).cast("decimal(19,0)")
    )
    return [
        F.min(ranked).alias("__first"),
        F.max(ranked).alias("__last"),
        F.max(micros).alias("__high"),
        F.min(micros).alias("__low"),
        F.sum("volume").alias("volume"),
    ]


def bar_fields() -> list[Column]:
    """The fields of a bar from its aggregates."""
    unit = F.lit(float(TICKS_PER_UNIT))

    def price_of(c: str) -> Column:
        slot = F.lit(_PRICE_SLOT).cast("decimal(19,0)")
        # a negative number before the slot makes the remainder negative as well
        shifted = F.pmod(F.col(c), slot).cast("bigint") - F.lit(_PRICE_SHIFT)
        return shifted.cast("double") / unit

    return [
        price_of("__first").alias("open"),
        (F.col("__high") / unit).alias("high"),
        (F.col("__low") / unit).alias("low"),
        price_of("__last").alias("close"),
        price_of("__last").alias("adj_close"),
        F.col("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, every: str = "day") -> DataFrame:
    """Aggregate ``(symbol, ts, seq, price, volume)`` into one bar per interval.

    ``seq`` (bigint) orders the ticks; equal numbers are ordered by price.
    Prices carry six decimals and lie within plus or minus ``MAX_PRICE``;
    negative ones come through unchanged, for validation to find.  ``adj_close``
    equals ``close``: ticks carry no corporate actions.
    """
    return (
        ticks.select("symbol", _bucket(F.col("ts"), every).alias("date"), "seq", "price", "volume")
        .groupBy("symbol", "date")
        .agg(*bar_aggregates())
        .select("symbol", "date", *bar_fields())
    )


def trade_ticks(lineitem: DataFrame, part: DataFrame, symbol: str) -> DataFrame:
    """Order lines as ticks: unit price after discount and tax, by ``symbol``.

    Only the needed columns of both sides are read.  The join is left to the
    optimiser: it broadcasts the parts only below its size threshold, and
    adaptive execution splits a part number that holds too many lines.
    """
    price = (
        F.col("p_retailprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    )
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
        F.col(symbol).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        price.alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def event_ticks(events: DataFrame) -> DataFrame:
    """The event stream as ticks: one symbol per event type, unit volume."""
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )
