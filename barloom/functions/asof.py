"""As-of joins in bounded stretches of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import scratch

#: Days of one stretch; a group's rows meet in one task per stretch, never as a whole.
STRETCH_DAYS = 366


def _day(x: Column) -> Column:
    return F.unix_date(x.cast("date"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    forward: bool = False,
    exact: bool = True,
    name: str = "found",
    stretch_days: int = STRETCH_DAYS,
) -> DataFrame:
    """``left`` with ``name``: the nearest row of ``right`` of the same group that is not later.

    Both sides have the keys and the column ``time`` (a date or a timestamp);
    ``name`` is a struct of the right row's other columns and ``time``, null
    where there is none.  ``forward`` takes the nearest row that is not earlier;
    without ``exact`` rows of the same time do not count.

    Both sides are laid on stretches of time.  The last right row of each
    stretch is carried into the stretches after it, one small row each, and
    within a stretch one window passes over the rows; a group with most rows is
    dealt over its stretches.  Of right rows that tie in group and time, the
    greatest by content is taken.  Rows with a null key or time find nothing.
    """
    ours, mark, at, when, seen, carried = scratch([*left.columns, *right.columns], "ours", "mark", "at", "when", "seen", "carried")
    known = F.col(time).isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    packed = right.where(known).select(
        *keys, F.col(time), F.struct(time, *[c for c in right.columns if c not in (*keys, time)]).alias(seen)
    )
    sign = -1 if forward else 1
    # one order for both directions: a forward search is a backward one on mirrored time
    micros = F.unix_micros(F.col(time).cast("timestamp")) * sign
    place = F.floor(sign * _day(F.col(time)) / stretch_days)
    lines = left.select(*keys, F.col(time), F.struct(*left.columns).alias(ours)).unionByName(packed, allowMissingColumns=True)
    # of one time, what is looked for comes before or after the row that looks
    first = F.col(ours).isNotNull() if not exact else F.col(ours).isNull()
    lines = lines.withColumns({when: micros, at: place, mark: F.when(first, 0).otherwise(1)})
    here = Window.partitionBy(*keys, at).orderBy(when, mark, seen).rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        lines.where(F.col(seen).isNotNull()).groupBy(*keys, at)
        .agg(F.max_by(seen, F.struct(when, seen)).alias(carried))
    )
    stretches = lines.select(*keys, at).distinct().join(ends, [*keys, at], "left")
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn(carried, F.last(carried, ignorenulls=True).over(earlier))
    found = F.coalesce(F.last(seen, ignorenulls=True).over(here), F.col(carried))
    return (
        lines.join(stretches, [*keys, at], "left").withColumn(name, found)
        .where(F.col(ours).isNotNull()).select(f"{ours}.*", name)
    )
