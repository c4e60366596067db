"""Raw bar files to the canonical panel schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import TRADING_DAYS, ratio
from barloom.functions.windows import by_date
from barloom.operators.cleaning import FIELDS, keep_latest

#: Accepted spellings of the six fields (lower case, stripped).
ALIASES = {
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "adj close": "adj_close",
    "adjclose": "adj_close",
    "adj_close": "adj_close",
    "volume": "volume",
}


class LoadError(ValueError):
    """Data is absent or does not have the required columns."""


def field_of(name: str) -> str | None:
    """The canonical field behind a column name, if it is one."""
    text = name.strip().lower()
    return ALIASES.get(text) or ALIASES.get(text.replace("_", " "))


#: Where rows came from, as taken along by a reader: file and time of its last change.
SOURCE = ("__file", "__changed")


def with_source(df: DataFrame) -> DataFrame:
    """Rows of a file source with the file they came from."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(SOURCE[0]),
        F.col("_metadata.file_modification_time").alias(SOURCE[1]),
    )


def number_arrivals(df: DataFrame) -> DataFrame:
    """``ingest_seq``: consecutive numbers by change time of the file, its path, and row.

    Tasks read file splits in an order of their own, so the running number of
    Spark only orders rows within one split.  The table that puts the splits in
    order has one row for each, which bounds its window and its size.
    """
    number = F.monotonically_increasing_id()
    rows = df.withColumn("__part", F.shiftright(number, 33)).withColumn(
        "__row", number.bitwiseAND((1 << 33) - 1)
    )
    before = Window.orderBy(SOURCE[1], SOURCE[0], "__part").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        rows.groupBy(*SOURCE, "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
        .drop("__n", "__first")
    )
    return (
        rows.join(splits, [*SOURCE, "__part"])
        .withColumn("ingest_seq", F.col("__base") + F.col("__row"))
        .drop(*SOURCE, "__part", "__row", "__base")
    )


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Landed files, numbered in arrival order: the file changed last comes last."""
    if fmt == "csv":
        options = {"header": True, **options}
    return number_arrivals(with_source(spark.read.format(fmt).options(**options).load(path)))


def unreadable_dates(df: DataFrame, date_col: str = "date", tz: str | None = None) -> DataFrame:
    """Rows whose date cannot be read; ``normalise`` has no place for them."""
    when = next(c for c in df.columns if c.lower() == date_col.lower())
    return df.where(_date_of(when, dict(df.dtypes)[when], tz).isNull())


def normalise(
    df: DataFrame,
    symbol: str | None = None,
    date_col: str = "date",
    symbol_col: str = "symbol",
    tz: str | None = None,
    seq: str = "ingest_seq",
) -> DataFrame:
    """Canonical names and types, one row per (symbol, date), newest kept.

    ``symbol`` labels a single-instrument frame; otherwise ``symbol_col`` is
    read.  Of several columns meaning the same field the first wins.  Text that
    is not a number becomes missing.  A frame without ``adj_close`` is already
    adjusted, so ``close`` serves as both.
    """
    types = dict(df.dtypes)
    found: dict[str, str] = {}
    for name in df.columns:
        field = field_of(name)
        if field and field not in found:
            found[field] = name
    if "adj_close" not in found and "close" in found:
        found["adj_close"] = found["close"]
    lacking = [f for f in FIELDS if f not in found]
    if lacking:
        raise LoadError(f"missing columns {lacking}; have {df.columns}")

    when = next((c for c in df.columns if c.lower() == date_col.lower()), None)
    if when is None:
        raise LoadError(f"no date column {date_col!r}")
    who = F.lit(symbol) if symbol else F.col(f"`{symbol_col}`")
    order = F.col(seq) if seq in df.columns else F.monotonically_increasing_id()

    def number(name: str) -> Column:
        x = F.col(f"`{name}`").try_cast("double")
        return F.when(~F.isnan(x), x)

    rows = df.select(
        F.upper(F.trim(who.cast("string"))).alias("symbol"),
        _date_of(when, types[when], tz).alias("date"),
        *[number(found[f]).alias(f) for f in FIELDS],
        order.alias("ingest_seq"),
    )
    return keep_latest(rows.where(F.col("date").isNotNull())).drop("copies")


def _date_of(name: str, dtype: str, tz: str | None) -> Column:
    c = F.col(f"`{name}`")
    if dtype == "timestamp" and tz:
        return F.to_date(F.from_utc_timestamp(c, tz))
    if dtype == "string":
        return F.substring(F.trim(c), 1, 10).try_cast("date")
    return F.to_date(c)


def wide_to_long(
    df: DataFrame,
    date_col: str = "date",
    sep: str = "|",
    symbols: list[str] | None = None,
) -> DataFrame:
    """A two-level header flattened to ``field|symbol`` columns, made long.

    Either level may come first.  All symbols (or those asked for) come out of
    one generator per row; nothing is shuffled.
    """
    cells: dict[str, dict[str, str]] = {}
    for name in df.columns:
        left, mark, right = name.partition(sep)
        if not mark:
            continue
        field, who = (left, right) if field_of(left) else (right, left)
        field = field_of(field)
        who = who.strip().upper()
        if field and (symbols is None or who in {s.upper() for s in symbols}):
            cells.setdefault(who, {}).setdefault(field, name)
    if not cells:
        raise LoadError(f"no price fields in {df.columns}")

    fields = [f for f in FIELDS if any(f in c for c in cells.values())]
    one = [
        F.struct(
            F.lit(who).alias("symbol"),
            *[
                (F.col(f"`{names[f]}`") if f in names else F.lit(None)).cast("string").alias(f)
                for f in fields
            ],
        )
        for who, names in cells.items()
    ]
    keep = [c for c in df.columns if c == date_col or c == "ingest_seq"]
    return df.select(*keep, F.explode(F.array(*one)).alias("bar")).select(*keep, "bar.*")


def require_rows(df: DataFrame, what: str = "request") -> DataFrame:
    if df.isEmpty():
        raise LoadError(f"no rows for {what}")
    return df


def describe(bars: DataFrame) -> DataFrame:
    """Headline statistics per symbol in one aggregate after one window."""
    n = F.count(F.lit(1))
    first, last = F.min_by("adj_close", "date"), F.max_by("adj_close", "date")
    move = ratio("adj_close", F.lag("adj_close").over(by_date("symbol"))) - 1
    r = F.col("__r")
    return (
        bars.withColumn("__r", move)
        .groupBy("symbol")
        .agg(
            n.alias("rows"),
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            n.alias("trading_days"),
            F.round(n / TRADING_DAYS, 2).alias("years"),
            first.alias("first_close"),
            last.alias("last_close"),
            ((ratio(last, first) - 1) * 100).alias("total_return_pct"),
            (F.avg(r) * 100).alias("mean_daily_return_pct"),
            (F.stddev_samp(r) * 100).alias("daily_volatility_pct"),
            (F.stddev_samp(r) * TRADING_DAYS**0.5 * 100).alias("annualised_volatility_pct"),
            F.avg("volume").alias("mean_volume"),
            F.sum(sum((F.col(c).isNull().cast("int") for c in FIELDS), start=F.lit(0))).alias(
                "missing_values"
            ),
        )
    )
