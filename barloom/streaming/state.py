"""Features of new bars from a small state per symbol, without the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import FeatureSpec
from barloom.functions.windows import first_n
from barloom.operators.cleaning import FIELDS
from barloom.operators.features import build_features, carries, feature_names, look_back

#: Bars kept beyond the look-back: the first return of a tail needs the bar before it.
SPARE = 1


def _tail(built: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The newest bars of each symbol, as many as any window reads, with what the smoothers carry."""
    kept = first_n(built, look_back(spec) + SPARE, ["symbol"], F.desc("date"))
    return kept.select("symbol", "date", *FIELDS, *[f"c_{c}" for c in carries(spec)], "seen")


def feature_state(bars: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """The state of every symbol after its cleaned history.

    Per symbol the adjusted bars of the longest look-back, the values of the
    smoothers and the on-balance volume at each of them (``c_*``), and ``seen``,
    the number of bars so far.  Its size does not depend on the history.
    """
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    built = build_features(bars, spec, dropna=False, carried=True)
    return _tail(built.withColumn("seen", F.count(F.lit(1)).over(w)), spec)


def advance(state: DataFrame, fresh: DataFrame, spec: FeatureSpec = FeatureSpec()) -> tuple[DataFrame, DataFrame]:
    """Features of cleaned bars that follow the state, and the state after them.

    Returns feature rows ``(symbol, date, features)`` of the fresh bars, without
    those that lack a feature, and the new state.  Windows read the stored tail;
    smoothers and the on-balance volume go on from the carried values, so rows
    equal those of ``feature_matrix`` over the whole history.  A symbol that is
    still shorter than the tail is computed from its first bar, one without
    state starts with its fresh bars.

    Fresh bars on or before the last stored bar of their symbol are left out: a
    revised or restated history takes a new ``feature_state``.  Symbols without
    fresh bars keep their state.
    """
    names = feature_names(spec)
    last = state.groupBy("symbol").agg(
        F.max("date").alias("last"), F.max("seen").alias("before"), F.count(F.lit(1)).alias("stored")
    )
    new = (
        fresh.select("symbol", "date", *FIELDS).join(last.select("symbol", "last"), "symbol", "left")
        .where(F.col("last").isNull() | (F.col("date") > F.col("last"))).drop("last")
    )
    lines = state.drop("seen").withColumn("fresh", F.lit(False)).unionByName(
        new.withColumn("fresh", F.lit(True)), allowMissingColumns=True
    )
    line = Window.partitionBy("symbol").orderBy("date")
    number = F.sum(F.col("fresh").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    # older bars exist beyond the tail: go on from what is carried
    resumed = F.col("before") > F.col("stored")
    lines = lines.join(last.select("symbol", "before", "stored", "last"), "symbol", "left").withColumns(
        {"__new": number, "seen": F.coalesce("before", F.lit(0)) + number}
    )
    lines = lines.withColumn(
        "age", F.when(resumed, F.when(F.col("fresh"), F.col("__new")).when(F.col("date") == F.col("last"), 0).otherwise(-1))
    )
    kept = lines.select("symbol", "date", "fresh", "seen", *[F.col(f"c_{c}").alias(f"was_{c}") for c in carries(spec)])
    built = build_features(lines, spec, dropna=False, age="age", carried=True)
    built = built.join(kept, ["symbol", "date"])
    rows = built.where("fresh").select("symbol", "date", *names).dropna(subset=names)
    # stored bars keep what they carried; before the last one the smoothers were not run again
    carried = {f"c_{c}": F.when(F.col("fresh") | F.col(f"was_{c}").isNull(), F.col(f"c_{c}")).otherwise(F.col(f"was_{c}"))
               for c in carries(spec)}
    return rows, _tail(built.withColumns(carried), spec)
