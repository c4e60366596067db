"""Positions, ranks and quantiles of rows in an order, without a task that holds a whole group.

Groups that contain a symbol are bounded by its calendar and keep to plain
windows and ``percentile``; these are for groups that pool symbols.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import scratch
from barloom.functions.durable import written

#: Intervals into which one round of ``order_statistics`` divides what is left.
BINS = 4096


def _ahead(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], amount: Column, inside: str, ahead: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before each in its group, as ``inside`` + ``ahead``.

    Rows are dealt over ranges of (group, order), so a group that holds most
    rows spans many tasks.  ``ahead`` is what earlier ranges hold of the group:
    one small row per range and group; ``inside`` what the row's own range does.
    The sorted rows are written once, so that both stay true.
    """
    place, part, n = scratch([*df.columns, inside, ahead], "place", "part", "n")
    rows = written(
        df.withColumn(n, amount).orderBy(*[F.col(g) for g in group], *order)
        .withColumn(place, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(place, 33))
    ranges = rows.groupBy(part, *group).agg(F.sum(n).alias(n))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col(part).alias(f"{part}_r"), *[F.col(g).alias(f"{part}_{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(ahead),
    )
    same = F.col(part) == F.col(f"{part}_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"{part}_{i}"))
    own = Window.partitionBy(part, *group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(inside, F.coalesce(F.sum(n).over(own), F.lit(0))).join(ranges, same).select(
        *df.columns, inside, ahead
    )


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: the number of each row, from 1, in its group under ``order``.

    Rows are dealt over ranges of (group, order), so a group that holds most
    rows spans many tasks.  A range numbers its own rows; what the ranges before
    it hold of the group is one small row per range and group, and is added.

    Nulls are a group of their own and sort first, unless ``order`` says
    otherwise.  Rows that tie in everything are numbered in any order.  The
    sorted rows are written once, so numbers stay as they are.
    """
    place, part, low, before, n = scratch(df.columns, "place", "part", "low", "before", "n")
    keys = [F.col(g) for g in group]
    rows = written(df.orderBy(*keys, *order).withColumn(place, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(place, 33))
    ranges = rows.groupBy(part, *group).agg(F.min(place).alias(low), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col(part).alias(f"{part}_r"), *[F.col(g).alias(f"{part}_{i}") for i, g in enumerate(group)], low,
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before),
    )
    same = F.col(part) == F.col(f"{part}_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"{part}_{i}"))
    return rows.join(ranges, same).select(
        *df.columns, (F.col(place) - F.col(low) + F.col(before) + 1).alias(name)
    )


def average_ranks(df: DataFrame, x: str, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``x`` in its group, ties sharing their mean rank.

    Only distinct values and their counts are sorted; rows look their value up.
    ``x`` has no nulls.
    """
    n, inside, ahead = scratch([*df.columns, name], "n", "inside", "ahead")
    values = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias(n))
    ranked = _ahead(values, keys, [x], F.col(n), inside, ahead)
    ranked = ranked.select(
        *[F.col(c).alias(f"{n}_{i}") for i, c in enumerate((*keys, x))],
        (F.col(inside) + F.col(ahead) + (F.col(n) + 1) / 2.0).alias(name),
    )
    same = F.lit(True)
    for i, c in enumerate((*keys, x)):
        same &= F.col(c).eqNullSafe(F.col(f"{n}_{i}"))
    return df.join(ranked, same).select(*df.columns, name)


def order_statistics(df: DataFrame, x: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, at, value)``: the values of ``x`` at the 0-based places ``wanted (keys, at)`` of each group.

    Repeated counting: every round divides the interval that must hold a value
    into ``BINS`` and counts what falls where, combined before the shuffle; the
    bin with the place becomes the next interval, cut to its least and greatest
    value, until these are one.  No task holds more than the counts.  ``x`` has
    no nulls.
    """
    rows = written(df.select(*keys, F.col(x).cast("double").alias("x")))
    bounds = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    open_ = written(wanted.select(*keys, "at").distinct().join(bounds, list(keys)).withColumn("skip", F.lit(0).cast("bigint")))
    done = []
    while True:
        done.append(open_.where("lo = hi").select(*keys, "at", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        # halves, because the distance of two doubles may exceed the largest double
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = rows.join(open_, list(keys)).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        counted = inside.groupBy(*keys, "at", "skip", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        upto = Window.partitionBy(*keys, "at").orderBy("bin")
        placed = counted.withColumn("after", F.col("skip") + F.sum("n").over(upto)).where(
            (F.col("at") < F.col("after")) & (F.col("at") >= F.col("after") - F.col("n"))
        )
        open_ = written(placed.select(*keys, "at", "lo", "hi", (F.col("after") - F.col("n")).alias("skip")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def quantiles(df: DataFrame, x: str, shares: Sequence[float], keys: Sequence[str], name: str) -> DataFrame:
    """``(keys, name)``: the exact interpolated quantiles of ``x``, like an array of ``percentile``.

    Nulls are left out; a group without values has null quantiles.
    """
    group = [f"__k{i}" for i in range(max(len(keys), 1))]
    named = [F.coalesce(F.to_json(F.struct(F.col(k).alias("k"))), F.lit("")) for k in keys] or [F.lit("")]
    rows = df.select(*[k.alias(g) for k, g in zip(named, group)], F.col(x).alias("x"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("p")) for i, s in enumerate(shares)])
    spots = (
        rows.where("x IS NOT NULL").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        .select(*group, F.explode(places).alias("s")).select(*group, "s.i", "s.p")
    )
    spots = written(
        spots.withColumns({"lo": F.floor("p").cast("bigint"), "hi": F.ceil("p").cast("bigint")})
    )
    wanted = spots.select(*group, F.explode(F.array("lo", "hi")).alias("at"))
    found = order_statistics(rows.where("x IS NOT NULL"), "x", wanted, group)
    side = [found.select(*group, F.col("at").alias(c), F.col("value").alias(f"v{c}")) for c in ("lo", "hi")]
    both = spots.join(side[0], [*group, "lo"]).join(side[1], [*group, "hi"])
    value = F.when(F.col("vlo") == F.col("vhi"), F.col("vlo")).otherwise(
        (F.col("hi") - F.col("p")) * F.col("vlo") + (F.col("p") - F.col("lo")) * F.col("vhi")
    )
    packed = both.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q"))
    known = df.select(*keys, *[k.alias(g) for k, g in zip(named, group)]).distinct()
    return known.join(packed, group, "left").select(*keys, F.col("q.v").alias(name))
