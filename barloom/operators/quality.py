"""Validation: report what is wrong with raw bars without changing them.

Raw rows are unbounded per symbol and per date, so every check is either an
aggregate with map-side combine, a bounded-chunk scan, or a window over the
distinct dates of a symbol (bounded by the calendar).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import TRADING_DAYS, is_infinite
from barloom.functions.windows import by_date, previous_in_arrival
from barloom.operators.cleaning import (
    FIELDS,
    PRICES,
    any_of,
    body_outside_range,
    cleaning_log,
    mark_cleaning,
)

#: Check names and how severe each finding is.
SEVERITY = {
    "empty": "error",
    "schema": "error",
    "duplicate_dates": "error",
    "date_ordering": "error",
    "missing_values": "error",
    "infinite_values": "error",
    "nonpositive_prices": "error",
    "negative_volume": "error",
    "high_below_low": "error",
    "ohlc_inconsistent": "error",
    "zero_volume": "warning",
    "extreme_returns": "warning",
}
#: Tolerated absent weekdays a year, example dates of a finding.
HOLIDAYS_PER_YEAR = 12
EXAMPLES = 5


def missing_columns(df: DataFrame) -> list[str]:
    """Schema check; a frame that fails it is not examined further."""
    return [c for c in ("symbol", "date", *FIELDS) if c not in df.columns]


def _is_extreme(limit: float) -> Column:
    """Move of adj_close beyond ``limit`` against the last known price."""
    now, before = F.col("adj_close"), F.col("prev_adj_close")
    move = F.abs(F.try_divide(now, before) - 1)
    return F.when(before == 0, now != 0).otherwise(~F.isnan(move) & (move > limit))


def _row_findings(raw: DataFrame, extreme_return: float, seq: str) -> DataFrame:
    ordered = previous_in_arrival(raw, ["adj_close", "date"], seq=seq)
    checks = {
        "missing_values": any_of([F.col(c).isNull() for c in FIELDS]),
        "infinite_values": any_of([is_infinite(c) for c in FIELDS]),
        "nonpositive_prices": any_of([F.col(c) <= 0 for c in PRICES]),
        "negative_volume": F.col("volume") < 0,
        "high_below_low": F.col("high") < F.col("low"),
        "ohlc_inconsistent": body_outside_range(),
        "zero_volume": F.col("volume") == 0,
        "extreme_returns": _is_extreme(extreme_return),
        "date_ordering": F.col("date") < F.col("prev_date"),
    }
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return ordered.select(
        "symbol",
        F.explode(fired).alias("check"),
        "date",
        F.lit(1).cast("bigint").alias("weight"),
        F.lit(None).cast("int").alias("tolerance"),
    )


def weekdays_between(first: Column, last: Column) -> Column:
    """Number of Monday-to-Friday dates in [first, last]."""
    days = F.datediff(last, first) + 1
    start = F.weekday(first)
    spare = days % 7
    partial = F.size(
        F.filter(
            F.sequence(F.lit(0), F.greatest(spare - 1, F.lit(0))),
            lambda i: (i < spare) & ((start + i) % 7 < 5),
        )
    )
    return (F.floor(days / 7) * 5 + partial).cast("int")


def calendar_gaps(dates: DataFrame) -> DataFrame:
    """Absent weekdays between a symbol's first and last bar, with the tolerance.

    ``dates`` holds distinct (symbol, date).  Only the holes are expanded, each
    from the bar before it, so the cost follows the gaps and not the calendar.
    """
    w = by_date("symbol")
    span = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    expected = weekdays_between(F.first("date").over(span), F.last("date").over(span))
    tolerance = F.ceil(
        expected / F.lit(TRADING_DAYS) * F.lit(HOLIDAYS_PER_YEAR)
    ).cast("int")
    holes = dates.withColumns(
        {"following": F.lead("date").over(w), "tolerance": tolerance}
    ).where(F.datediff("following", "date") > 1)
    return (
        holes.select(
            "symbol",
            "tolerance",
            F.explode(
                F.sequence(F.date_add("date", 1), F.date_sub("following", 1))
            ).alias("date"),
        )
        .where(F.weekday("date") < 5)
        .select("symbol", "date", "tolerance")
    )


def validate(
    raw: DataFrame,
    extreme_return: float = 0.5,
    expected: DataFrame | None = None,
    seq: str = "ingest_seq",
) -> DataFrame:
    """One row per (symbol, check) that fired: severity, count, example dates.

    ``expected`` (a ``symbol`` column) adds an ``empty`` finding for every
    symbol without rows.
    """
    lacking = missing_columns(raw)
    spark = raw.sparkSession
    if lacking:
        return spark.createDataFrame(
            [(None, "schema", SEVERITY["schema"], len(lacking), [])],
            "symbol string, check string, severity string, count bigint, "
            "example_dates array<date>",
        )

    per_date = raw.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("weight"))
    doubled = per_date.where(F.col("weight") > 1).select(
        "symbol",
        F.lit("duplicate_dates").alias("check"),
        "date",
        "weight",
        F.lit(None).cast("int").alias("tolerance"),
    )
    gaps = calendar_gaps(per_date.select("symbol", "date")).select(
        "symbol",
        F.lit("calendar_gaps").alias("check"),
        "date",
        F.lit(1).cast("bigint").alias("weight"),
        "tolerance",
    )
    findings = (
        _row_findings(raw, extreme_return, seq)
        .unionByName(doubled)
        .unionByName(gaps)
    )
    if expected is not None:
        absent = expected.join(raw.select("symbol").distinct(), "symbol", "left_anti")
        findings = findings.unionByName(
            absent.select(
                "symbol",
                F.lit("empty").alias("check"),
                F.lit(None).cast("date").alias("date"),
                F.lit(1).cast("bigint").alias("weight"),
                F.lit(None).cast("int").alias("tolerance"),
            )
        )

    # One row per date first: it combines before the shuffle and leaves a
    # symbol with no more rows per check than the calendar has days.
    daily = findings.groupBy("symbol", "check", "date").agg(
        F.sum("weight").alias("weight"),
        F.count(F.lit(1)).alias("times"),
        F.max("tolerance").alias("tolerance"),
    )
    place = F.row_number().over(Window.partitionBy("symbol", "check").orderBy("date"))
    shown = F.when(
        (F.col("place") <= EXAMPLES) & F.col("date").isNotNull(),
        F.array_repeat("date", F.least("times", F.lit(EXAMPLES)).cast("int")),
    )
    unordered = F.col("check") == "date_ordering"
    by_name = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    severity = F.when(
        F.col("check") == "calendar_gaps",
        F.when(F.col("weight") > F.col("tolerance"), "warning").otherwise("info"),
    ).otherwise(by_name[F.col("check")])
    return (
        daily.withColumn("place", place)
        .groupBy("symbol", "check")
        .agg(
            F.sum("weight").alias("weight"),
            F.max("tolerance").alias("tolerance"),
            F.slice(F.array_sort(F.flatten(F.collect_list(shown))), 1, EXAMPLES).alias("dates"),
        )
        .select(
            "symbol",
            "check",
            severity.alias("severity"),
            # Broken order is one finding, however many dates step back.
            F.when(unordered, 1).otherwise(F.col("weight")).cast("bigint").alias("count"),
            F.when(unordered, F.array().cast("array<date>"))
            .otherwise(F.col("dates"))
            .alias("example_dates"),
        )
    )


def report_summary(issues: DataFrame, raw: DataFrame) -> DataFrame:
    """Per symbol: rows seen, is_valid (no error), and findings by severity."""
    def n(severity: str) -> Column:
        return F.count_if(F.col("severity") == severity)

    rows = raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    found = issues.groupBy("symbol").agg(
        n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("notes")
    )
    zero = F.lit(0).cast("bigint")
    return rows.join(found, "symbol", "full").select(
        "symbol",
        F.coalesce("n_rows", zero).alias("n_rows"),
        (F.coalesce("errors", zero) == 0).alias("is_valid"),
        *[F.coalesce(c, zero).alias(c) for c in ("errors", "warnings", "notes")],
    )


def validate_and_clean(raw: DataFrame, **options):
    """Validate, clean, validate again: (cleaned, before, after, log)."""
    marked = mark_cleaning(raw, **options)
    cleaned = marked.where(F.col("dropped").isNull()).select("symbol", "date", *FIELDS)
    numbered = cleaned.withColumn(
        "ingest_seq", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    )
    return cleaned, validate(raw), validate(numbered), cleaning_log(marked)
