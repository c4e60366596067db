"""Report content as rows: (symbol, section, item, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import KEYS
from barloom.operators.eda import top_by_magnitude

#: The verdicts.
OUTPERFORMED = "outperformed"
MORE_RETURN_MORE_RISK = "more_return_more_risk"
LESS_RETURN_LESS_DRAWDOWN = "less_return_less_drawdown"
DID_NOT_BEAT = "did_not_beat"
INCONCLUSIVE = "inconclusive"

TOP_FEATURES = 12


def verdict(comparison: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reading of strategy minus benchmark, per key.

    A missing difference in Sharpe ratio or drawdown counts as not better.
    """
    def diff(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("difference")))

    d = comparison.groupBy(*keys).agg(
        diff("total_return").alias("return_difference"),
        diff("sharpe_ratio").alias("sharpe_difference"),
        diff("max_drawdown").alias("drawdown_difference"),
    )
    better = {
        c: F.coalesce(F.col(f"{c}_difference") > 0, F.lit(False))
        for c in ("return", "sharpe", "drawdown")
    }
    return d.withColumn(
        "verdict",
        F.when(F.col("return_difference").isNull(), INCONCLUSIVE)
        .when(better["return"] & better["sharpe"], OUTPERFORMED)
        .when(better["return"], MORE_RETURN_MORE_RISK)
        .when(better["drawdown"], LESS_RETURN_LESS_DRAWDOWN)
        .otherwise(DID_NOT_BEAT),
    )


def correlation_headline(corr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strongest absolute correlation, the feature behind it, and the median."""
    size = F.abs("corr")
    return corr.groupBy(*keys).agg(
        F.max(size).alias("max_abs"),
        F.max_by("feature", size).alias("strongest"),
        F.median(size).alias("median_abs"),
    )


def section(
    df: DataFrame, name: str, keys: Sequence[str] = KEYS, item: Sequence[str] = ()
) -> DataFrame:
    """Any table as (keys, section, item, value) rows, values as text.

    The item names the row by its ``item`` columns, then the column.
    """
    fixed = {*keys, *item}
    names = [c for c in df.columns if c not in fixed]

    def text(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        if kind.startswith("array"):
            return F.concat_ws("; ", F.col(c).cast("array<string>"))
        return (F.round(c, 6) if kind == "double" else F.col(c)).cast("string")

    prefix = F.concat_ws("/", *[F.col(c).cast("string") for c in item]) if item else F.lit("")
    return (
        df.select(*keys, prefix.alias("__row"), *[text(c).alias(c) for c in names])
        .unpivot([*keys, "__row"], names, "__col", "value")
        .select(
            *keys,
            F.lit(name).alias("section"),
            F.when(F.col("__row") == "", F.col("__col"))
            .otherwise(F.concat_ws("/", "__row", "__col"))
            .alias("item"),
            "value",
        )
    )


#: Which columns name a row in each section.
ROW_NAMES = {
    "splits": ("split",),
    "model_metrics": ("split",),
    "importance": ("feature",),
    "comparison": ("metric",),
    "walk_forward": ("fold",),
    "stability": ("metric",),
    "regimes": ("breakdown", "regime"),
    "cost_sweep": ("cost_bps",),
    "threshold_sweep": ("threshold",),
    "period_sweep": ("period",),
    "robustness": ("sweep",),
}


def report_sections(
    tables: Mapping[str, DataFrame], keys: Sequence[str] = KEYS
) -> DataFrame:
    """All given tables in one long frame.  ``importance`` is cut to the top 12."""
    out = None
    for name, table in tables.items():
        if name == "importance":
            table = top_by_magnitude(table, "importance", TOP_FEATURES, keys)
        part = section(table, name, keys, ROW_NAMES.get(name, ()))
        out = part if out is None else out.unionByName(part)
    return out


def report_text(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One text per key; a report has a bounded number of lines."""
    line = F.concat(F.col("item"), F.lit(": "), F.coalesce("value", F.lit("n/a")))
    parts = sections.groupBy(*keys, "section").agg(
        F.concat(
            F.lit("## "),
            F.first("section"),
            F.lit("\n"),
            F.concat_ws("\n", F.array_sort(F.collect_list(line))),
        ).alias("body")
    )
    return parts.groupBy(*keys).agg(
        F.concat_ws("\n\n", F.array_sort(F.collect_list("body"))).alias("report")
    )
