"""Registered queries: each operator on the driver tables, with its check SQL.

``QUERIES[name](spark, folder)`` returns a DataFrame over the whole tables;
``ORACLES[name]`` states the same result in SQL where SQL can.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.asof import asof_join
from barloom.functions.durable import bucketed, ensure_checkpoint_dir, written
from barloom.functions.windows import by_date
from barloom.operators import (
    backtest as bt,
)
from barloom.operators import (
    cleaning,
    eda,
    evaluate,
    feature_stats,
    indicators,
    metrics,
    models,
    quality,
    regimes,
    report,
    signals,
    stress,
    target,
    walkforward,
)
from barloom.operators.features import FEATURES, build_features, feature_matrix
from barloom.operators.linear import fit_linear, linear_importance, predict_linear
from barloom.plans import inputs, study
from barloom.plans import oracle_parts as sql
from barloom.plans.inputs import SPEC
from barloom.plans.oracle_parts import num, rounded, with_sql
from barloom.sources import logs, panel_store, raw_bars
from barloom.sources.ticks import bars_from_ticks, event_ticks
from barloom.streaming import ingest, live, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and without a negative zero, for comparison by value."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# ------------------------------------------------------------------- bars

_BAR_NUMBERS = num("open", "high", "low", "close", "adj_close", "volume")
_BARS = f"SELECT symbol, date, {_BAR_NUMBERS} FROM bars"


@query("bars_daily", with_sql(sql.trade_bars(), _BARS))
def bars_daily(spark, sf):
    return tidy(inputs.trade_bars(spark, sf))


@query("bars_weekly", with_sql(sql.trade_bars(every="week"), _BARS))
def bars_weekly(spark, sf):
    return tidy(inputs.trade_bars(spark, sf, every="week"))


@query("bars_daily_by_brand", with_sql(sql.trade_bars("p_brand"), _BARS))
def bars_daily_by_brand(spark, sf):
    return tidy(inputs.trade_bars(spark, sf, "p_brand"))


@query("bars_hourly_events", with_sql(sql.event_bars(), _BARS))
def bars_hourly_events(spark, sf):
    return tidy(inputs.event_bars(spark, sf))


# ---------------------------------------------------------------- sources


@query(
    "dataset_describe",
    with_sql(
        f"""{sql.trade_bars()},
moves AS (SELECT *, adj_close / lag(adj_close) OVER ({sql.SERIES}) - 1 AS r FROM bars)""",
        f"""SELECT symbol, count(*) AS rows, min(date) AS start, max(date) AS "end",
  count(*) AS trading_days, {rounded('count(*) / 252.0', 'years', 2)},
  {rounded('arg_min(adj_close, date)', 'first_close')},
  {rounded('arg_max(adj_close, date)', 'last_close')},
  {rounded('(arg_max(adj_close, date) / arg_min(adj_close, date) - 1) * 100', 'total_return_pct')},
  {rounded('avg(r) * 100', 'mean_daily_return_pct')},
  {rounded('stddev_samp(r) * 100', 'daily_volatility_pct')},
  {rounded('stddev_samp(r) * sqrt(252) * 100', 'annualised_volatility_pct')},
  {rounded('avg(volume)', 'mean_volume')}, CAST(0 AS BIGINT) AS missing_values
FROM moves GROUP BY symbol""",
    ),
)
def dataset_describe(spark, sf):
    return tidy(raw_bars.describe(inputs.trade_bars(spark, sf)))


@query(
    "latest_bar",
    with_sql(sql.trade_bars("p_brand"), "SELECT symbol, max(date) AS latest FROM bars GROUP BY 1"),
)
def latest_bar(spark, sf):
    return panel_store.latest_bar(inputs.trade_bars(spark, sf, "p_brand"))


@query(
    "history_coverage",
    with_sql(
        sql.trade_bars("p_brand"),
        """SELECT symbol, min(date) FILTER (d) AS first_in_range,
  count(*) FILTER (d) AS rows_in_range,
  coalesce(min(date) FILTER (d) <= DATE '1996-07-08' + 10, false) AS covers_start
FROM (SELECT symbol, date, date BETWEEN DATE '1996-07-08' AND DATE '1999-03-31' AS d FROM bars)
GROUP BY symbol""",
    ),
)
def history_coverage(spark, sf):
    bars = inputs.trade_bars(spark, sf, "p_brand")
    return panel_store.history_coverage(bars, "1996-07-08", "1999-03-31")


@query(
    "normalise_raw",
    with_sql(
        sql.cleaned_bars(),
        f"SELECT symbol, date, {_BAR_NUMBERS} FROM ranked WHERE pick = 1",
    ),
)
def normalise_raw(spark, sf):
    raw = inputs.raw_bars(spark, sf).withColumnsRenamed(
        {"open": "Open", "high": " HIGH", "adj_close": "Adj Close", "date": "Date"}
    )
    return tidy(raw_bars.normalise(raw))


_RESTATED = f"""{sql.trade_bars()},
fresh AS (
  SELECT * REPLACE (adj_close * CASE WHEN symbol = 'N' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS adj_close)
  FROM bars WHERE date >= DATE '2001-06-01'),
stored AS (SELECT * FROM bars WHERE date <= DATE '2001-07-01')"""


def _kept_bars(spark, sf, symbol: str = "l_returnflag"):
    """Trade bars written once, for stores that take several increments from them.

    Each increment would read the ticks again otherwise, and send the parts
    through the driver again for their join.
    """
    return written(inputs.trade_bars(spark, sf, symbol))


def _increment(spark, sf, bars=None):
    bars = inputs.trade_bars(spark, sf) if bars is None else bars
    factor = F.when(F.col("symbol") == "N", 0.95).otherwise(1.0)
    fresh = bars.where("date >= DATE '2001-06-01'").withColumn(
        "adj_close", F.col("adj_close") * factor
    )
    return bars.where("date <= DATE '2001-07-01'"), fresh


@query(
    "restatement_check",
    with_sql(
        _RESTATED,
        f"""SELECT symbol, max(s.date) AS shared_date,
  {rounded('arg_max(s.adj_close / s.close, s.date)', 'old_basis')},
  {rounded('arg_max(f.adj_close / f.close, s.date)', 'new_basis')},
  NOT (abs(arg_max(s.adj_close / s.close, s.date) - arg_max(f.adj_close / f.close, s.date))
    <= 1e-8 + 1e-6 * abs(arg_max(f.adj_close / f.close, s.date))) AS restated
FROM stored s JOIN fresh f USING (symbol, date) GROUP BY symbol""",
    ),
)
def restatement_check(spark, sf):
    return tidy(panel_store.restatements(*_increment(spark, sf)))


@query(
    "merge_newest",
    with_sql(
        _RESTATED,
        "SELECT symbol, date, "
        + ", ".join(rounded(f"coalesce(f.{c}, s.{c})", c) for c in cleaning.FIELDS)
        + " FROM stored s FULL JOIN fresh f USING (symbol, date)",
    ),
)
def merge_newest(spark, sf):
    return tidy(panel_store.merge_newest(*_increment(spark, sf)))


_REBASED = (
    "adj_close * CASE WHEN symbol = 'N' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END"
)


def _new_store(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "incremental_store",
    with_sql(
        sql.trade_bars(),
        f"""SELECT symbol, date, {num('open', 'high', 'low', 'close', digits=8)},
  {rounded(_REBASED, 'adj_close', 8)}, {num('volume', digits=8)} FROM bars""",
    ),
)
def incremental_store(spark, sf):
    """Store a history, merge an increment that restates one symbol, read it back."""
    bars = _kept_bars(spark, sf)
    stored, fresh = _increment(spark, sf, bars)
    root = _new_store(spark, "store")
    panel_store.write_batch(stored, root, 0)

    def full_history(symbols):
        rebased = bars.withColumn("adj_close", F.col("adj_close") * 0.95)
        return rebased.join(symbols, "symbol", "left_semi")

    ingest.merge_increment(spark, fresh, root, 1, full_history)
    return tidy(panel_store.read_panel(spark, root), 8)


@query(
    "store_range_after_reload",
    with_sql(
        sql.trade_bars(),
        f"SELECT symbol, date, {_BAR_NUMBERS} FROM bars "
        "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND symbol <> 'R'",
    ),
)
def store_range_after_reload(spark, sf):
    """A later reload of one symbol, outside the range asked for, makes its older rows stale."""
    bars = _kept_bars(spark, sf)
    root = _new_store(spark, "reloaded")
    panel_store.write_batch(bars, root, 0)
    panel_store.write_batch(
        bars.where("symbol = 'R' AND date >= DATE '1999-01-01'"), root, 1, panel_store.RELOAD
    )
    return tidy(panel_store.read_panel(spark, root, ["A", "N", "R"], "1996-01-01", "1997-12-31"))


@query(
    "held_back_increment",
    with_sql(
        sql.trade_bars(),
        f"""SELECT symbol, date, {num('open', 'high', 'low', 'close', digits=8)},
  {rounded(_REBASED, 'adj_close', 8)}, {num('volume', digits=8)} FROM bars""",
    ),
)
def held_back_increment(spark, sf):
    """Increments of a restated symbol wait without a source and come in with its reload."""
    bars = _kept_bars(spark, sf)
    factor = F.when(F.col("symbol") == "N", 0.95).otherwise(1.0)
    rebased = bars.withColumn("adj_close", F.col("adj_close") * factor)
    root = _new_store(spark, "held")
    panel_store.write_batch(bars.where("date <= DATE '1999-12-31'"), root, 0)
    for batch, (lo, hi) in enumerate((("1999-12-01", "2000-06-30"), ("2000-07-01", "2000-12-31")), 1):
        ingest.merge_increment(spark, rebased.where(F.col("date").between(lo, hi)), root, batch)

    def history(symbols):
        # the source ends before the increments that wait
        return rebased.where("date <= DATE '2000-03-31'").join(symbols, "symbol", "left_semi")

    ingest.merge_increment(spark, rebased.where("date >= DATE '2001-01-01'"), root, 3, history)
    return tidy(panel_store.read_panel(spark, root), 8)


_HELD_SQL = ORACLES["held_back_increment"]


@query("store_compacted", _HELD_SQL)
def store_compacted(spark, sf):
    """The same increments, with the store folded into a new one while rows wait for their reload."""
    bars = _kept_bars(spark, sf)
    factor = F.when(F.col("symbol") == "N", 0.95).otherwise(1.0)
    rebased = bars.withColumn("adj_close", F.col("adj_close") * factor)
    root, target = _new_store(spark, "held"), _new_store(spark, "folded")
    panel_store.write_batch(bars.where("date <= DATE '1999-12-31'"), root, 0)
    for batch, (lo, hi) in enumerate((("1999-12-01", "2000-06-30"), ("2000-07-01", "2000-12-31")), 1):
        ingest.merge_increment(spark, rebased.where(F.col("date").between(lo, hi)), root, batch)
    panel_store.compact(spark, root, target)

    def history(symbols):
        return rebased.where("date <= DATE '2000-03-31'").join(symbols, "symbol", "left_semi")

    ingest.merge_increment(spark, rebased.where("date >= DATE '2001-01-01'"), target, 3, history)
    return tidy(panel_store.read_panel(spark, target), 8)


def _quarters(spark, sf, name: str) -> str:
    """A store of quarterly increments, each revising the volume of the last week of the one before."""
    bars = _kept_bars(spark, sf)
    root = _new_store(spark, name)
    starts = [f"{y}-{m:02d}-01" for y in (1999, 2000, 2001) for m in (1, 4, 7, 10)]
    panel_store.write_batch(bars.where("date < DATE '1999-01-01'"), root, 0)
    for batch, (lo, hi) in enumerate(zip(starts, [*starts[1:], "2002-01-01"]), 1):
        part = bars.where((F.col("date") >= F.date_sub(F.lit(lo).cast("date"), 7)) & (F.col("date") < hi))
        panel_store.write_batch(part.withColumn("volume", F.col("volume") + batch), root, batch)
    return root


def _quarterly(where: str) -> str:
    """SQL of what such a store holds: a day counts with the last increment that has it."""
    return f"""WITH RECURSIVE {sql.trade_bars()},
q AS (
  SELECT *, CASE WHEN date < DATE '1998-12-25' THEN 0 ELSE
    least((year(date + 7) - 1999) * 4 + quarter(date + 7), 12) END AS k FROM bars)
SELECT symbol, date, {num('open', 'high', 'low', 'close', 'adj_close')}, round(volume + k, 6) + 0.0 AS volume FROM q {where}"""


@query("store_tiers", _quarterly("WHERE date BETWEEN DATE '1999-02-01' AND DATE '2000-11-30' AND symbol <> 'R'"))
def store_tiers(spark, sf):
    """A range read of a store whose increments were merged by size."""
    root = _quarters(spark, sf, "tiers")
    panel_store.merge_tiers(spark, root)
    return tidy(panel_store.read_panel(spark, root, ["A", "N"], "1999-02-01", "2000-11-30"))


@query("store_old_version", _quarterly("WHERE date >= DATE '2001-01-01'"))
def store_old_version(spark, sf):
    """A reader that keeps to the version before a merge."""
    root = _quarters(spark, sf, "version")
    version = panel_store.versions(spark, root)[-1]
    panel_store.merge_tiers(spark, root)
    return tidy(panel_store.read_panel(spark, root, start="2001-01-01", version=version))


@query(
    "store_edges",
    with_sql(
        sql.trade_bars("p_brand"),
        f"""SELECT symbol, min(date) AS first, max(date) AS latest, {rounded('arg_min(adj_close / close, date)', 'first_basis')},
  {rounded('arg_max(adj_close / close, date) * 0.9', 'last_basis')}, coalesce(bool_or(
    date BETWEEN DATE '1996-07-08' AND DATE '1996-07-18'), false) AS covers_start FROM bars GROUP BY symbol""",
    ),
)
def store_edges(spark, sf):
    """What the zone maps tell of every symbol, after a revision of the last days."""
    bars = _kept_bars(spark, sf, "p_brand")
    root = _new_store(spark, "edges")
    panel_store.write_batch(bars, root, 0)
    late = bars.where("date >= DATE '1998-01-01'").withColumn("adj_close", F.col("adj_close") * 0.9)
    panel_store.write_batch(late, root, 1)
    return tidy(panel_store.stored_edges(spark, root).join(panel_store.stored_coverage(spark, root, "1996-07-08"), "symbol"))


@query(
    "store_restatements",
    ORACLES["restatement_check"],
)
def store_restatements(spark, sf):
    """The check of an increment against a store, decided by zone maps where they can."""
    stored, fresh = _increment(spark, sf, _kept_bars(spark, sf))
    root = _new_store(spark, "restated")
    panel_store.write_batch(stored, root, 0)
    return tidy(panel_store.stored_restatements(spark, root, fresh))


@query(
    "ingest_order",
    with_sql(
        sql.trade_bars(),
        f"""SELECT symbol, date, {num('open', 'high', 'low')},
  {rounded("CASE WHEN date >= DATE '1997-01-01' THEN close + 1 ELSE close END", 'close')},
  {num('adj_close', 'volume')} FROM bars""",
    ),
)
def ingest_order(spark, sf):
    """Two landed folders with shared days: the newer and larger file wins, whatever is read first."""
    bars = inputs.trade_bars(spark, sf)
    root = _new_store(spark, "landed")
    older = bars.where("date < DATE '1997-04-01'")
    newer = bars.where("date >= DATE '1997-01-01'").withColumn("close", F.col("close") + 1)
    older.coalesce(1).write.parquet(f"{root}/a")
    newer.coalesce(1).write.parquet(f"{root}/b")
    return tidy(raw_bars.normalise(raw_bars.read_raw(spark, [f"{root}/b", f"{root}/a"])))


_SHIFTED = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq,
         CAST(round((value - 50) * 1e6) AS BIGINT) AS px, 1.0::DOUBLE AS vol
  FROM events)"""


@query(
    "bars_negative_prices",
    with_sql(
        _SHIFTED,
        f"""SELECT symbol, CAST(ts AS DATE) AS date, {rounded('arg_min(px, row(seq, px)) / 1e6', 'open')},
  {rounded('max(px) / 1e6', 'high')}, {rounded('min(px) / 1e6', 'low')},
  {rounded('arg_max(px, row(seq, px)) / 1e6', 'close')},
  {rounded('arg_max(px, row(seq, px)) / 1e6', 'adj_close')}, {rounded('sum(vol)', 'volume')}
FROM ticks GROUP BY symbol, CAST(ts AS DATE)""",
    ),
)
def bars_negative_prices(spark, sf):
    """Prices below zero pass through unchanged; validation finds them later."""
    shifted = event_ticks(inputs.table(spark, sf, "events")).withColumn("price", F.col("price") - 50)
    return tidy(bars_from_ticks(shifted))


@query(
    "update_window",
    with_sql(
        _RESTATED,
        """SELECT s.symbol, s.date FROM bars s
JOIN (SELECT symbol, max(date) - 7 AS since FROM stored GROUP BY symbol) USING (symbol) WHERE s.date >= since""",
    ),
)
def update_window(spark, sf):
    """What an update reads again of the source: the overlap and the new days."""
    stored, _ = _increment(spark, sf)
    return panel_store.fresh_part(stored, inputs.trade_bars(spark, sf)).select("symbol", "date")


@query(
    "range_uncovered",
    with_sql(
        sql.trade_bars(),
        """SELECT symbol FROM bars GROUP BY symbol
HAVING symbol = 'A' OR coalesce(min(date) FILTER (date BETWEEN DATE '1995-01-02' AND DATE '1999-03-31')
  > DATE '1995-01-12', true)""",
    ),
)
def range_uncovered(spark, sf):
    bars = inputs.trade_bars(spark, sf)
    asked = bars.select("symbol").distinct()
    late = bars.where("symbol <> 'A' OR date >= DATE '1995-02-01'")
    return panel_store.uncovered(late, asked, "1995-01-02", "1999-03-31")


# ---------------------------------------------------------------- quality

_FINDINGS = f"""{sql.raw_bars()},
prior AS (
  SELECT *, last_value(adj_close IGNORE NULLS) OVER (
      PARTITION BY symbol ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa,
    lag(date) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS pd
  FROM raw),
moved AS (SELECT *, abs(adj_close / pa - 1) AS jump FROM prior),
days AS (SELECT DISTINCT symbol, date FROM raw),
span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM days GROUP BY symbol),
weekdays AS (
  SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
expected AS (SELECT * FROM weekdays WHERE isodow(date) < 6),
tolerance AS (
  SELECT symbol, CAST(ceil(count(*) / 252.0 * 12) AS INTEGER) AS tolerance
  FROM expected GROUP BY symbol),
gaps AS (SELECT symbol, date FROM expected ANTI JOIN days USING (symbol, date)),
findings AS (
  SELECT symbol, 'missing_values' AS "check", date, 1 AS weight FROM raw
    WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR adj_close IS NULL
       OR volume IS NULL
  UNION ALL SELECT symbol, 'infinite_values', date, 1 FROM raw
    WHERE abs(adj_close) = 'Infinity'::DOUBLE
  UNION ALL SELECT symbol, 'nonpositive_prices', date, 1 FROM raw
    WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR adj_close <= 0
  UNION ALL SELECT symbol, 'negative_volume', date, 1 FROM raw WHERE volume < 0
  UNION ALL SELECT symbol, 'high_below_low', date, 1 FROM raw WHERE high < low
  UNION ALL SELECT symbol, 'ohlc_inconsistent', date, 1 FROM raw
    WHERE close > high + 1e-6 OR close < low - 1e-6 OR open > high + 1e-6 OR open < low - 1e-6
  UNION ALL SELECT symbol, 'zero_volume', date, 1 FROM raw WHERE volume = 0
  UNION ALL SELECT symbol, 'extreme_returns', date, 1 FROM moved WHERE jump > 0.5 AND NOT isnan(jump)
  UNION ALL SELECT symbol, 'duplicate_dates', date, count(*) FROM raw GROUP BY symbol, date
    HAVING count(*) > 1
  UNION ALL SELECT symbol, 'date_ordering', NULL, 1 FROM prior WHERE date < pd GROUP BY symbol
  UNION ALL SELECT symbol, 'calendar_gaps', date, 1 FROM gaps),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "check" ORDER BY date) AS place FROM findings),
issues AS (
  SELECT symbol, "check",
    CASE WHEN "check" = 'calendar_gaps' THEN
           CASE WHEN sum(weight) > min(tolerance) THEN 'warning' ELSE 'info' END
         WHEN "check" IN ('zero_volume', 'extreme_returns') THEN 'warning' ELSE 'error' END AS severity,
    CAST(sum(weight) AS BIGINT) AS count,
    coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (place <= 5), '')
      AS example_dates
  FROM placed LEFT JOIN tolerance USING (symbol) GROUP BY symbol, "check")"""


@query("validation_report", with_sql(_FINDINGS, "SELECT * FROM issues"))
def validation_report(spark, sf):
    issues = quality.validate(inputs.raw_bars(spark, sf))
    return issues.withColumn("example_dates", F.array_join(F.col("example_dates").cast("array<string>"), ","))


@query(
    "validation_summary",
    with_sql(
        _FINDINGS,
        """SELECT symbol, n_rows, errors = 0 AS is_valid, errors, warnings, notes
FROM (SELECT symbol, count(*) AS n_rows FROM raw GROUP BY symbol) JOIN (
  SELECT symbol, count(*) FILTER (severity = 'error') AS errors,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS notes
  FROM issues GROUP BY symbol) USING (symbol)""",
    ),
)
def validation_summary(spark, sf):
    raw = inputs.raw_bars(spark, sf)
    return quality.report_summary(quality.validate(raw), raw)


@query(
    "calendar_gaps",
    with_sql(
        _FINDINGS,
        "SELECT symbol, date, tolerance FROM gaps JOIN tolerance USING (symbol)",
    ),
)
def calendar_gaps(spark, sf):
    return quality.calendar_gaps(inputs.raw_bars(spark, sf).select("symbol", "date").distinct())


@query(
    "clean_bars",
    with_sql(
        sql.cleaned_bars(), f"SELECT symbol, date, {_BAR_NUMBERS} FROM marked WHERE dropped IS NULL"
    ),
)
def clean_bars(spark, sf):
    return tidy(cleaning.clean(inputs.raw_bars(spark, sf)))


@query(
    "clean_without_zero_volume",
    with_sql(
        sql.cleaned_bars(),
        f"SELECT symbol, date, {_BAR_NUMBERS} FROM marked WHERE dropped IS NULL AND volume <> 0",
    ),
)
def clean_without_zero_volume(spark, sf):
    return tidy(cleaning.clean(inputs.raw_bars(spark, sf), drop_zero_volume=True))


@query(
    "wide_round_trip",
    with_sql(
        sql.trade_bars(),
        f"""SELECT symbol, date, {num('close', 'volume')}
FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT date FROM bars)
LEFT JOIN bars USING (symbol, date)""",
    ),
)
def wide_round_trip(spark, sf):
    """Bars as one wide row per date, ``field|symbol`` columns, and back; days without a bar are missing."""
    bars = inputs.trade_bars(spark, sf)
    symbols = [r[0] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]
    wide = bars.groupBy("date").agg(
        *[
            F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c}|{s}")
            for s in symbols
            for c in ("close", "volume")
        ]
    )
    long = raw_bars.wide_to_long(wide)
    return tidy(
        long.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("close", "volume")])
    )


@query(
    "basket_absent",
    with_sql(sql.trade_bars(), "SELECT 'ZZZ' AS symbol FROM bars LIMIT 1"),
)
def basket_absent(spark, sf):
    """Of the symbols asked for, those that are not stored."""
    root = _new_store(spark, "basket")
    panel_store.write_batch(inputs.trade_bars(spark, sf), root, 0)
    return panel_store.load_many(spark, root, ["A", "N", "ZZZ"])[1]


@query("basket_bars", with_sql(sql.trade_bars(), f"{_BARS} WHERE symbol IN ('A', 'N')"))
def basket_bars(spark, sf):
    """The bars of the symbols asked for that are stored."""
    root = _new_store(spark, "basket")
    panel_store.write_batch(inputs.trade_bars(spark, sf), root, 0)
    return tidy(panel_store.load_many(spark, root, ["A", "N", "ZZZ"])[0])


def _total(x: str, name: str) -> str:
    return f"CAST(sum({x}) AS BIGINT) AS {name}"


@query(
    "cleaning_log",
    with_sql(
        sql.cleaned_bars(),
        f"""SELECT symbol, {_total('copies', 'rows_before')},
  count(*) FILTER (dropped IS NULL) AS rows_after, {_total('copies - 1', 'duplicates_dropped')},
  {_total('n_infinite', 'infinite_to_missing')}, {_total('n_nonpositive', 'nonpositive_to_missing')},
  {_total('negative_volume', 'negative_volume_to_missing')}, {_total('n_filled', 'prices_filled')},
  count(*) FILTER (dropped = 'missing') AS missing_dropped,
  count(*) FILTER (dropped = 'impossible') AS impossible_dropped,
  CAST(0 AS BIGINT) AS zero_volume_dropped
FROM marked GROUP BY symbol""",
    ),
)
def cleaning_log(spark, sf):
    return cleaning.cleaning_log(cleaning.mark_cleaning(inputs.raw_bars(spark, sf)))


_SPLIT_DAY = "1998-01-01"


@query(
    "adjust_ohlc",
    with_sql(
        f"""{sql.trade_bars()},
factored AS (
  SELECT *, CASE WHEN date < DATE '{_SPLIT_DAY}' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS f FROM bars)""",
        f"""SELECT symbol, date, {rounded('open * f', 'open', 8)}, {rounded('high * f', 'high', 8)},
  {rounded('low * f', 'low', 8)}, {rounded('close * f', 'close', 8)},
  {rounded('close * f', 'adj_close', 8)}, {num('volume')} FROM factored""",
    ),
)
def adjust_ohlc(spark, sf):
    factor = F.when(F.col("date") < F.lit(_SPLIT_DAY).cast("date"), 0.25).otherwise(1.0)
    bars = inputs.trade_bars(spark, sf).withColumn("adj_close", F.col("close") * factor)
    return tidy(cleaning.adjust_ohlc(bars), 8)


# --------------------------------------------------------------- features

_WIDE = sql.features()


def _feature_query(name: str, columns: list[str], digits: int = 8) -> None:
    """One family of feature columns on every bar, warm-up included."""
    @query(
        name,
        with_sql(_WIDE, f"SELECT symbol, date, {num(*columns, digits=digits)} FROM wide"),
    )
    def family(spark, sf):
        built = build_features(inputs.trade_bars(spark, sf), dropna=False)
        return tidy(built.select("symbol", "date", *columns), digits)


for _name, _columns in {
    "returns_lags": [f for f in FEATURES if f.startswith(("ret_", "log_ret"))],
    "sma_ratios": [f for f in FEATURES if f.endswith("_ratio") and "sma_" in f],
    "volatility": [f for f in FEATURES if "vol_" in f],
    "volume_features": ["volume_change", "volume_sma", "volume_ratio", "volume_zscore",
                        "dollar_volume_ratio", "obv", "obv_zscore"],
    "range_features": ["high_low_range", "close_position", "gap_open"],
    "calendar_features": ["day_of_week", "month", "month_sin", "month_cos"],
    "dist_52w": ["dist_from_52w_high", "dist_from_52w_low"],
    "bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_pct_b", "bb_bandwidth"],
    "stochastic_k": ["stoch_k"],
    "ema_ratio": ["ema_12_26_ratio"],
    "macd": ["macd_norm", "macd_signal_norm", "macd_hist_norm"],
    "rsi": ["rsi_14"],
    "atr": ["atr", "atr_pct"],
}.items():
    _feature_query(_name, _columns)


@query("true_range", with_sql(_WIDE, f"SELECT symbol, date, {num('tr')} FROM b1"))
def true_range(spark, sf):
    bars = inputs.trade_bars(spark, sf)
    return tidy(bars.select("symbol", "date", indicators.true_range(by_date("symbol")).alias("tr")))


@query("obv", with_sql(_WIDE, f"SELECT symbol, date, {num('obv')} FROM b2"))
def obv(spark, sf):
    return tidy(indicators.obv(inputs.trade_bars(spark, sf)).select("symbol", "date", "obv"))


@query(
    "oscillators",
    with_sql(
        _WIDE,
        f"""SELECT symbol, date,
  {num('ema_fast', 'ema_slow', 'rsi', 'macd', 'macd_signal', 'atr')},
  {rounded('macd - macd_signal', 'macd_hist')} FROM wide""",
    ),
)
def oscillators(spark, sf):
    out = indicators.oscillators(inputs.trade_bars(spark, sf))
    return tidy(out.drop("open", "high", "low", "close", "adj_close", "volume"))


def _features(spark, sf):
    return build_features(inputs.trade_bars(spark, sf))


_FEAT = sql.complete(FEATURES)


@query(
    "feature_matrix",
    with_sql(_FEAT, f"SELECT symbol, date, {num(*FEATURES, digits=8)} FROM feat"),
)
def feature_matrix_query(spark, sf):
    return tidy(feature_matrix(_features(spark, sf)), 8)


_QUARTILES = ", ".join(
    rounded(f"quantile_cont(value, {q})", f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)
)


_POOLED = ("ret_1d", "rsi_14", "volume_ratio")


@query(
    "feature_quartiles_pooled",
    with_sql(
        f"{_WIDE},\n{sql.tall(_POOLED, 'wide')}",
        f"SELECT feature, count(value) AS count, {_QUARTILES} FROM long_feat GROUP BY feature",
    ),
)
def feature_quartiles_pooled(spark, sf):
    """Quartiles over all symbols, by repeated counting."""
    built = build_features(inputs.trade_bars(spark, sf), dropna=False)
    told = feature_stats.describe_features(built, _POOLED, keys=[])
    return tidy(told.select("feature", "count", "p25", "p50", "p75"))


@query(
    "feature_describe",
    with_sql(
        f"{_WIDE},\n{sql.tall(FEATURES, 'wide')}",
        f"""SELECT symbol, feature, count(value) AS count, {rounded('avg(value)', 'mean')},
  {rounded('stddev_samp(value)', 'std')}, {rounded('min(value)', 'min')}, {_QUARTILES},
  {rounded('max(value)', 'max')}, count(*) - count(value) AS missing,
  {rounded('(count(*) - count(value)) / count(*)::DOUBLE * 100', 'missing_pct', 2)},
  {rounded('skewness(value)', 'skew')}, {rounded('kurtosis(value)', 'kurtosis')}
FROM long_feat GROUP BY symbol, feature""",
    ),
)
def feature_describe(spark, sf):
    built = build_features(inputs.trade_bars(spark, sf), dropna=False)
    return tidy(feature_stats.describe_features(built))


_CORR = f"""{_FEAT},
futured AS (SELECT *, lead(close) OVER ({sql.SERIES}) / close - 1 AS future FROM feat),
{sql.tall(FEATURES, 'futured', 'symbol, future')},
corrs AS (SELECT symbol, feature, corr(value, future) AS corr FROM long_feat GROUP BY 1, 2)"""


@query(
    "future_corr",
    with_sql(
        _CORR,
        f"""SELECT symbol, feature, {num('corr', digits=8)}, CAST(row_number() OVER (
  PARTITION BY symbol ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM corrs""",
    ),
)
def future_corr(spark, sf):
    return tidy(feature_stats.future_return_correlation(_features(spark, sf)), 8)


@query(
    "leakage_report",
    with_sql(
        _CORR,
        f"""SELECT symbol, feature, {rounded('corr', 'corr_with_future', 4)},
  abs(corr) > 0.3 AS suspicious FROM corrs""",
    ),
)
def leakage_report(spark, sf):
    return tidy(feature_stats.leakage_report(_features(spark, sf)).drop("rank"), 4)


@query(
    "top_correlations",
    with_sql(
        _CORR,
        f"""SELECT symbol, feature, {num('corr', digits=8)} FROM corrs QUALIFY row_number() OVER (
  PARTITION BY symbol ORDER BY abs(corr) DESC NULLS LAST, feature) <= 10""",
    ),
)
def top_correlations(spark, sf):
    corr = feature_stats.future_return_correlation(_features(spark, sf)).drop("rank")
    return tidy(eda.top_by_magnitude(corr, "corr", 10), 8)


@query(
    "correlation_headline",
    with_sql(
        _CORR,
        f"""SELECT symbol, {rounded('max(abs(corr))', 'max_abs')},
  arg_max(feature, abs(corr)) AS strongest, {rounded('median(abs(corr))', 'median_abs')}
FROM corrs GROUP BY symbol""",
    ),
)
def correlation_headline(spark, sf):
    corr = feature_stats.future_return_correlation(_features(spark, sf))
    return tidy(report.correlation_headline(corr))


@query(
    "feature_corr_matrix",
    with_sql(
        _FEAT,
        " UNION ALL ".join(
            f"SELECT symbol, '{a}' AS feature, unnest([{', '.join(repr(b) for b in FEATURES)}]) AS other, "
            f"unnest([{', '.join(f'round(corr({a}, {b}), 6) + 0.0' for b in FEATURES)}]) AS corr "
            "FROM feat GROUP BY symbol"
            for a in FEATURES
        ),
    ),
)
def feature_corr_matrix(spark, sf):
    return tidy(feature_stats.correlation_matrix(_features(spark, sf)))


@query(
    "rebuild_test",
    with_sql(
        sql.trade_bars(),
        f"""SELECT symbol, max(date) FILTER (pos <= floor(n * 0.8)) AS cut_date, CAST(43 AS INTEGER) AS compared,
  CAST(0 AS INTEGER) AS n_offenders
FROM (SELECT symbol, date, row_number() OVER ({sql.SERIES}) AS pos,
        count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY symbol""",
    ),
)
def rebuild_test(spark, sf):
    found = feature_stats.rebuild_test(inputs.trade_bars(spark, sf))
    return found.withColumn("n_offenders", F.size("offenders")).drop("offenders")


# ----------------------------------------------------------------- target

_DATA = sql.dataset(FEATURES, SPEC.train_end, SPEC.valid_end)


def _dataset(spark, sf, kind: str = "regression"):
    labelled = target.attach_target(_features(spark, sf), kind=kind)
    return target.chronological_split(labelled, SPEC.train_end, SPEC.valid_end)


@query(
    "target_regression",
    with_sql(_DATA, f"SELECT symbol, date, split, {num('target', 'return_1d_fwd', digits=8)} FROM data"),
)
def target_regression(spark, sf):
    cols = ("symbol", "date", "split", "target", "return_1d_fwd")
    return tidy(_dataset(spark, sf).select(*cols), 8)


@query(
    "target_classification",
    with_sql(
        _DATA,
        """SELECT symbol, date, split, CASE WHEN target > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target
FROM data""",
    ),
)
def target_classification(spark, sf):
    return _dataset(spark, sf, "classification").select("symbol", "date", "split", "target")


@query(
    "split_summary",
    with_sql(
        _DATA,
        f"""SELECT symbol, split, count(*) AS rows, min(date) AS start, max(date) AS "end",
  {rounded('count(*) / 252.0', 'years', 2)} FROM data GROUP BY symbol, split""",
    ),
)
def split_summary(spark, sf):
    return tidy(target.split_summary(_dataset(spark, sf)))


@query(
    "split_check",
    with_sql(
        _DATA,
        "SELECT symbol, 'valid is empty' AS fault FROM data WHERE symbol = 'A' GROUP BY symbol",
    ),
)
def split_check(spark, sf):
    """A symbol without its middle part is reported, the others are not."""
    return target.split_faults(_dataset(spark, sf).where("symbol <> 'A' OR split <> 'valid'"))


@query(
    "class_balance",
    with_sql(
        _DATA,
        f"""SELECT symbol, split, {rounded('avg(CAST(target > 0 AS INTEGER)) * 100', 'up_pct')},
  {rounded('100 - avg(CAST(target > 0 AS INTEGER)) * 100', 'down_pct')}, count(*) AS n
FROM data GROUP BY symbol, split""",
    ),
)
def class_balance(spark, sf):
    return tidy(target.class_balance(_dataset(spark, sf), keys=["symbol", "split"]))


@query(
    "target_summary",
    with_sql(
        _DATA,
        f"""SELECT symbol, count(*) AS n, {rounded('avg(target) * 100', 'mean_pct')},
  {rounded('stddev_samp(target) * 100', 'std_pct')}, {rounded('min(target) * 100', 'min_pct')},
  {rounded('max(target) * 100', 'max_pct')},
  {rounded('avg(CAST(target > 0 AS INTEGER)) * 100', 'pct_positive')},
  {rounded('skewness(target)', 'skew')}, {rounded('kurtosis(target)', 'kurtosis')}
FROM data GROUP BY symbol""",
    ),
)
def target_summary(spark, sf):
    return tidy(target.target_summary(_dataset(spark, sf)))


@query(
    "realised_returns",
    with_sql(
        _DATA,
        f"""SELECT symbol, date, split, {rounded(
            'coalesce(close / lag(close) OVER (PARTITION BY symbol, split ORDER BY date) - 1, 0)',
            'asset_return', 8)} FROM data""",
    ),
)
def realised_returns(spark, sf):
    out = target.realised_returns(_dataset(spark, sf))
    return tidy(out.select("symbol", "date", "split", "asset_return"), 8)


# ---------------------------------------------------------------- signals

_PRED = sql.momentum()
_BT = f"{_PRED},\n{sql.backtest()}"
BAND = 0.01


def _signalled(spark, sf, threshold=0.0, allow_short=True):
    return signals.generate_signals(
        inputs.momentum(spark, sf), threshold=threshold, allow_short=allow_short
    )


@query(
    "signals",
    with_sql(
        f"{_PRED},\n{sql.backtest(threshold=str(BAND))}",
        f"SELECT symbol, date, {num('prediction', 'signal')} FROM sig",
    ),
)
def signals_query(spark, sf):
    out = _signalled(spark, sf, BAND)
    return tidy(out.select("symbol", "date", "prediction", "signal"))


def _summary_sql(keys: str) -> str:
    over = f"PARTITION BY {keys} ORDER BY date"
    def share(v: int) -> str:
        return f"avg(CASE WHEN signal = {v} THEN 100.0 ELSE 0.0 END)"
    return f"""switches AS (
  SELECT *, CASE WHEN signal <> coalesce(lag(signal) OVER ({over}), 0) THEN 1 ELSE 0 END AS s
  FROM sig),
summary AS (
  SELECT {keys}, count(*) AS n, {rounded(share(1), 'long_pct')}, {rounded(share(0), 'flat_pct')},
    {rounded(share(-1), 'short_pct')},
    {rounded('avg(CASE WHEN signal <> 0 THEN 100.0 ELSE 0.0 END)', 'exposure_pct')},
    CAST(sum(s) AS BIGINT) AS n_changes,
    {rounded('coalesce(count(*) FILTER (signal <> 0) / nullif(sum(s), 0)::DOUBLE, count(*))',
             'avg_holding_days')}
  FROM switches GROUP BY {keys})"""


@query("signal_summary", with_sql(f"{_BT},\n{_summary_sql('symbol')}", "SELECT * FROM summary"))
def signal_summary(spark, sf):
    return tidy(signals.signal_summary(_signalled(spark, sf)))


_THRESHOLDS = (0.0, 0.005, 0.01, 0.02, 0.05)


def _grid_sql(source: str, name: str, values) -> str:
    points = ", ".join(f"{v}::DOUBLE" for v in values)
    return f"{source},\ngridded AS (SELECT *, unnest([{points}]) AS {name} FROM pred)"


@query(
    "threshold_sweep",
    with_sql(
        f"""{_grid_sql(_PRED, 'threshold', _THRESHOLDS)},
{sql.backtest('gridded', 'symbol, threshold', 'threshold')},
{_summary_sql('symbol, threshold')}""",
        "SELECT * FROM summary",
    ),
)
def threshold_sweep(spark, sf):
    return tidy(signals.threshold_sweep(inputs.momentum(spark, sf), _THRESHOLDS, allow_short=True))


@query(
    "suggest_threshold",
    with_sql(
        _PRED,
        f"SELECT symbol, {rounded('greatest(quantile_cont(prediction, 0.7), 0)', 'threshold', 8)} "
        "FROM pred GROUP BY symbol",
    ),
)
def suggest_threshold(spark, sf):
    return tidy(signals.suggest_threshold(inputs.momentum(spark, sf), 30.0), 8)


@query(
    "suggest_threshold_pooled",
    with_sql(
        _PRED,
        f"SELECT year(date) AS year, {rounded('greatest(quantile_cont(prediction, 0.7), 0)', 'threshold', 8)} "
        "FROM pred GROUP BY ALL",
    ),
)
def suggest_threshold_pooled(spark, sf):
    """One threshold a year for all symbols, by repeated counting."""
    yearly = inputs.momentum(spark, sf).withColumn("year", F.year("date").cast("bigint"))
    return tidy(signals.suggest_threshold(yearly, 30.0, keys=["year"]), 8)


# --------------------------------------------------------------- backtest


def _result(spark, sf):
    return bt.run_backtest(_signalled(spark, sf))


@query(
    "backtest_weekly",
    with_sql(_BT, f"SELECT symbol, date, {num(*bt.RESULT)} FROM bt"),
)
def backtest_weekly(spark, sf):
    return tidy(_result(spark, sf).select("symbol", "date", *bt.RESULT))


@query(
    "backtest_daily_log_equity",
    with_sql(
        f"{sql.momentum('day')},\n{sql.backtest()}",
        f"""SELECT symbol, date, {num('position', 'cost', 'strategy_return')},
  {rounded('ln(equity)', 'log_equity')}, {rounded('ln(benchmark_equity)', 'log_benchmark')}
FROM bt""",
    ),
)
def backtest_daily_log_equity(spark, sf):
    rows = signals.generate_signals(inputs.momentum(spark, sf, "day"), allow_short=True)
    out = bt.run_backtest(rows)
    return tidy(
        out.select(
            "symbol", "date", "position", "cost", "strategy_return",
            F.ln("equity").alias("log_equity"), F.ln("benchmark_equity").alias("log_benchmark"),
        )
    )


@query(
    "portfolio_value",
    with_sql(
        _BT,
        f"""SELECT symbol, date, {rounded('equity * 1e4', 'portfolio_value', 3)},
  {rounded('benchmark_equity * 1e4', 'benchmark_value', 3)} FROM bt""",
    ),
)
def portfolio_value(spark, sf):
    out = bt.portfolio_value(_result(spark, sf))
    return tidy(out.select("symbol", "date", "portfolio_value", "benchmark_value"), 3)


@query(
    "buy_and_hold",
    with_sql(
        f"{_PRED.replace('AS prediction', 'AS p0, 1 AS prediction')},\n{sql.backtest(bps='0')}",
        f"SELECT symbol, date, {num('position', 'strategy_return', 'equity')} FROM bt",
    ),
)
def buy_and_hold(spark, sf):
    out = bt.run_buy_and_hold(inputs.momentum(spark, sf))
    return tidy(out.select("symbol", "date", "position", "strategy_return", "equity"))


_TRADES = f"{_BT},\n{sql.trades()}"
_TRADE_NUMBERS = num("entry_price", "exit_price", "gross_return", "cost", "net_return")


@query(
    "trade_log",
    with_sql(
        _TRADES,
        f"SELECT symbol, entry_date, exit_date, direction, holding_days, {_TRADE_NUMBERS}, win "
        "FROM trades",
    ),
)
def trade_log(spark, sf):
    return tidy(bt.trade_log(_result(spark, sf)))


@query(
    "trade_stats",
    with_sql(
        _TRADES,
        f"""SELECT symbol, count(*) AS n_trades, count(*) FILTER (win) AS n_wins,
  count(*) FILTER (NOT win) AS n_losses,
  {rounded('count(*) FILTER (win) / count(*)::DOUBLE', 'win_rate')},
  {rounded('avg(net_return) FILTER (win)', 'avg_win')},
  {rounded('avg(net_return) FILTER (NOT win)', 'avg_loss')},
  {rounded('avg(net_return)', 'avg_trade')}, {rounded('max(net_return)', 'best_trade')},
  {rounded('min(net_return)', 'worst_trade')}, {rounded('avg(holding_days)', 'avg_holding_days')},
  {rounded('avg(net_return) FILTER (win) / abs(avg(net_return) FILTER (NOT win))', 'payoff_ratio')}
FROM trades GROUP BY symbol""",
    ),
)
def trade_stats(spark, sf):
    return tidy(metrics.trade_statistics(bt.trade_log(_result(spark, sf))))


@query(
    "trade_markers",
    with_sql(
        _TRADES,
        f"""SELECT symbol, date, direction, kind, {num('price')} FROM (
  SELECT symbol, entry_date AS date, direction, 'entry' AS kind, entry_price AS price FROM trades
  UNION ALL SELECT symbol, exit_date, direction, 'exit', exit_price FROM trades)""",
    ),
)
def trade_markers(spark, sf):
    # read twice: as bars and for the trades on them
    result = study.checkpointed(_result(spark, sf))
    return tidy(eda.trade_markers(bt.trade_log(result), result))


@query(
    "backtest_totals",
    with_sql(
        _TRADES,
        f"""SELECT symbol, n_trades, {num('total_cost', 'exposure')} FROM (
  SELECT symbol, sum(cost) AS total_cost,
         avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END) AS exposure FROM bt GROUP BY symbol)
JOIN (SELECT symbol, count(*) AS n_trades FROM trades GROUP BY symbol) USING (symbol)""",
    ),
)
def backtest_totals(spark, sf):
    return tidy(bt.backtest_totals(_result(spark, sf)))


# ---------------------------------------------------------------- metrics

_NUMBERS = [m for m in sql.METRICS if m not in ("n_days", "max_drawdown_days")]
_PERF = f"""{_BT},
measured AS (SELECT *, strategy_return AS r FROM bt),
{sql.performance('measured', 'symbol',
                 extra=', avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END) AS exposure')}"""


@query(
    "performance_summary",
    with_sql(
        _PERF,
        f"SELECT symbol, {num(*_NUMBERS, 'exposure')}, max_drawdown_days, n_days FROM perf",
    ),
)
def performance_summary(spark, sf):
    return tidy(metrics.performance_summary(_result(spark, sf), position="position"))


def _comparison_sql(bt: str) -> str:
    both = f"""{bt},
stacked AS (
  SELECT symbol, date, 'strategy' AS series, strategy_return AS r, position FROM bt
  UNION ALL SELECT symbol, date, 'buy_and_hold', asset_return, NULL FROM bt),
{sql.performance('stacked', 'symbol, series',
                 extra=', avg(CASE WHEN position <> 0 THEN 1.0 WHEN position = 0 THEN 0.0 END)'
                       ' AS exposure')}"""
    rows = " UNION ALL ".join(
        f"SELECT symbol, series, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM perf"
        for m in (*sql.METRICS, "exposure")
    )
    return f"""{both},
tall AS ({rows}),
comparison AS (
  SELECT symbol, metric, max(value) FILTER (series = 'strategy') AS strategy,
    max(value) FILTER (series = 'buy_and_hold') AS buy_and_hold,
    max(value) FILTER (series = 'strategy') - max(value) FILTER (series = 'buy_and_hold')
      AS difference
  FROM tall GROUP BY symbol, metric)"""


_COMPARISON = _comparison_sql(_BT)


@query(
    "benchmark_comparison",
    with_sql(
        _COMPARISON,
        f"SELECT symbol, metric, {num('strategy', 'buy_and_hold', 'difference')} FROM comparison",
    ),
)
def benchmark_comparison(spark, sf):
    return tidy(metrics.compare_to_benchmark(_result(spark, sf)))


@query(
    "summary_table",
    with_sql(
        _COMPARISON,
        "SELECT symbol, series, "
        + ", ".join(rounded(f"CAST({m} AS DOUBLE)", m) for m in (*sql.METRICS, "exposure"))
        + " FROM perf",
    ),
)
def summary_table(spark, sf):
    both = metrics.performance(
        _result(spark, sf),
        {"strategy": "strategy_return", "buy_and_hold": "asset_return"},
        positions={"strategy": "position"},
    )
    tall = metrics.long_form(both, ["symbol", "series"])
    return tidy(metrics.summary_table(tall, "series", ["symbol"]))


@query(
    "drawdown_series",
    with_sql(
        _PERF,
        f"SELECT symbol, date, {rounded('dd', 'drawdown')}, CAST(wet AS BIGINT) AS days_under_water "
        "FROM perf_run",
    ),
)
def drawdown_series(spark, sf):
    return tidy(metrics.drawdown_series(_result(spark, sf)))


@query(
    "equity_curve",
    with_sql(_PERF, f"SELECT symbol, date, {rounded('eq * 100', 'equity_curve', 4)} FROM perf_eq"),
)
def equity_curve(spark, sf):
    out = metrics.equity_curve(_result(spark, sf), initial=100.0)
    return tidy(out.select("symbol", "date", "equity_curve"), 4)


# ---------------------------------------------------------------- regimes


def _vol_sql(bars: str, causal: bool = False) -> str:
    over = "PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cut = (
        f"CASE WHEN count(vol) OVER ({over}) >= 60 THEN quantile_cont(vol, {{}}) OVER ({over}) END"
        if causal
        else "quantile_cont(vol, {}) OVER (PARTITION BY symbol)"
    )
    return f"""{bars},
moves AS (SELECT *, close / lag(close) OVER ({sql.SERIES}) - 1 AS mv FROM {{source}}),
vols AS (SELECT *, {sql.roll('stddev_samp', 'mv', 20)} AS vol,
                {sql.roll('avg', 'close', 200)} AS mean_200 FROM moves),
cuts AS (SELECT *, {cut.format('1.0/3')} AS lower, {cut.format('2.0/3')} AS upper FROM vols),
labelled AS (
  SELECT *, CASE WHEN vol IS NULL OR lower IS NULL THEN NULL WHEN vol > upper THEN 'high_vol'
                 WHEN vol <= lower THEN 'low_vol' ELSE 'medium_vol' END AS vol_regime,
         CASE WHEN mean_200 IS NULL THEN NULL WHEN close > mean_200 THEN 'bull' ELSE 'bear' END
           AS trend_regime
  FROM cuts)"""


def _labels(bars: str, source: str = "bars", causal: bool = False) -> str:
    return _vol_sql(bars, causal).replace("{source}", source)


@query(
    "regime_vol",
    with_sql(_labels(sql.trade_bars()), "SELECT symbol, date, vol_regime FROM labelled"),
)
def regime_vol(spark, sf):
    out = regimes.volatility_regime(inputs.trade_bars(spark, sf))
    return out.select("symbol", "date", "vol_regime")


@query(
    "regime_vol_causal",
    with_sql(
        _labels(sql.trade_bars(), causal=True), "SELECT symbol, date, vol_regime FROM labelled"
    ),
)
def regime_vol_causal(spark, sf):
    out = regimes.volatility_regime(inputs.trade_bars(spark, sf), causal=True)
    return out.select("symbol", "date", "vol_regime")


@query(
    "regime_labels",
    with_sql(
        _labels(sql.trade_bars()),
        """SELECT symbol, date, vol_regime, trend_regime, trend_regime || '_' || vol_regime AS regime
FROM labelled""",
    ),
)
def regime_labels(spark, sf):
    out = regimes.label_regimes(inputs.trade_bars(spark, sf))
    return out.select("symbol", "date", "vol_regime", "trend_regime", "regime")


_TAGGED = f"""{_labels(_BT, 'bt')},
tagged AS (
  SELECT symbol, date, strategy_return, asset_return, 'volatility' AS breakdown, vol_regime AS regime
    FROM labelled
  UNION ALL SELECT symbol, date, strategy_return, asset_return, 'trend', trend_regime FROM labelled
  UNION ALL SELECT symbol, date, strategy_return, asset_return, 'combined',
    trend_regime || '_' || vol_regime FROM labelled),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY symbol, breakdown, regime) AS days,
         count(*) OVER (PARTITION BY symbol, breakdown) AS labelled_days
  FROM tagged WHERE regime IS NOT NULL),
sides AS (
  SELECT symbol, date, breakdown, regime, days, labelled_days, 'strategy' AS series,
         strategy_return AS r FROM sized WHERE days >= 20
  UNION ALL SELECT symbol, date, breakdown, regime, days, labelled_days, 'benchmark', asset_return
    FROM sized WHERE days >= 20),
{sql.performance('sides', 'symbol, breakdown, regime, days, labelled_days, series')},
by_regime AS (
  SELECT s.symbol, s.breakdown, s.regime, s.days, s.days / s.labelled_days::DOUBLE * 100 AS pct_of_sample,
    s.total_return AS strategy_total_return, b.total_return AS benchmark_total_return,
    s.total_return - b.total_return AS excess_return, s.sharpe_ratio AS strategy_sharpe,
    b.sharpe_ratio AS benchmark_sharpe, s.max_drawdown AS strategy_max_drawdown,
    b.max_drawdown AS benchmark_max_drawdown, s.win_rate AS strategy_win_rate,
    b.win_rate AS benchmark_win_rate, s.total_return > b.total_return AS outperformed
  FROM perf s JOIN perf b USING (symbol, breakdown, regime)
  WHERE s.series = 'strategy' AND b.series = 'benchmark')"""


@query(
    "regime_performance",
    with_sql(
        _TAGGED,
        f"""SELECT symbol, breakdown, regime, days, outperformed, {num(
            'pct_of_sample', 'strategy_total_return', 'benchmark_total_return', 'excess_return',
            'strategy_sharpe', 'benchmark_sharpe', 'strategy_max_drawdown',
            'benchmark_max_drawdown', 'strategy_win_rate', 'benchmark_win_rate')} FROM by_regime""",
    ),
)
def regime_performance(spark, sf):
    return tidy(regimes.regime_report(_result(spark, sf)))


@query(
    "regime_consistency",
    with_sql(
        _TAGGED,
        f"""SELECT symbol, breakdown, count(*) AS n_regimes,
  count(*) FILTER (outperformed) AS n_outperformed,
  {rounded('count(*) FILTER (outperformed) / count(*)::DOUBLE * 100', 'pct_outperformed')},
  {rounded('min(excess_return)', 'worst_excess')}, {rounded('max(excess_return)', 'best_excess')},
  {rounded('avg(excess_return)', 'mean_excess')} FROM by_regime GROUP BY symbol, breakdown""",
    ),
)
def regime_consistency(spark, sf):
    return tidy(regimes.consistency_score(regimes.regime_report(_result(spark, sf))))


@query(
    "regime_pairs",
    with_sql(
        _TAGGED,
        f"""SELECT symbol, breakdown, regime, 'strategy' AS series,
  {rounded('strategy_total_return', 'total_return')} FROM by_regime
UNION ALL SELECT symbol, breakdown, regime, 'benchmark',
  {rounded('benchmark_total_return', 'total_return')} FROM by_regime""",
    ),
)
def regime_pairs(spark, sf):
    return tidy(eda.regime_pairs(regimes.regime_report(_result(spark, sf))))


# ----------------------------------------------------------------- stress

_COSTS = (0.0, 1.0, 5.0, 10.0, 20.0, 50.0)
_RUN = f"{num(*sql.RUN_NUMBERS)}, CAST(n_trades AS BIGINT) AS n_trades, beats_buy_and_hold"
_RELATIVE = num("buy_and_hold_return", "excess_return")
_COST_RUNS = (
    f"{_grid_sql(_PRED, 'cost_bps', _COSTS)},\n"
    + sql.score_runs("gridded", "symbol, cost_bps", "0", "cost_bps")
)
_PERIODS = f"""{_PRED},
spaced AS (
  SELECT *, row_number() OVER ({sql.SERIES}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
  FROM pred),
blocks AS (
  SELECT *, CAST(1 + CAST(pos >= trunc(n / 4.0) AS INTEGER) + CAST(pos >= trunc(2 * (n / 4.0)) AS INTEGER)
         + CAST(pos >= trunc(3 * (n / 4.0)) AS INTEGER) AS INTEGER) AS period FROM spaced),
sizes AS (
  SELECT symbol, period, min(date) AS start, max(date) AS "end", count(*) AS days
  FROM blocks GROUP BY symbol, period),
{sql.score_runs('blocks', 'symbol, period', '0', '7')}"""


@query("sweep_cost", with_sql(_COST_RUNS, f"SELECT symbol, cost_bps, {_RUN} FROM runs_scored"))
def sweep_cost(spark, sf):
    return tidy(stress.sweep_costs(inputs.momentum(spark, sf), _COSTS))


@query(
    "sweep_threshold",
    with_sql(
        f"{_grid_sql(_PRED, 'threshold', _THRESHOLDS)},\n"
        + sql.score_runs("gridded", "symbol, threshold", "threshold", "7"),
        f"SELECT symbol, threshold, {_RUN} FROM runs_scored",
    ),
)
def sweep_threshold(spark, sf):
    return tidy(stress.sweep_thresholds(inputs.momentum(spark, sf), _THRESHOLDS))


@query(
    "sweep_period",
    with_sql(
        _PERIODS,
        f"""SELECT symbol, period, start, "end", days, {_RUN}, {_RELATIVE}
FROM runs_scored JOIN sizes USING (symbol, period) WHERE days >= 20""",
    ),
)
def sweep_period(spark, sf):
    # read twice: for the sizes of the periods and for the runs
    return tidy(stress.sweep_periods(study.checkpointed(inputs.momentum(spark, sf))))


@query(
    "sweep_curve",
    with_sql(_COST_RUNS, f"SELECT symbol, cost_bps AS x, {rounded('total_return', 'y')} FROM runs_scored"),
)
def sweep_curve(spark, sf):
    swept = stress.sweep_costs(inputs.momentum(spark, sf), _COSTS)
    return tidy(eda.sweep_curve(swept, "cost_bps", "total_return"))


@query(
    "sweep_symbol",
    with_sql(
        f"{_PRED},\n{sql.score_runs('pred', 'symbol', '0', '7')}",
        f"SELECT symbol, {_RUN}, {_RELATIVE} FROM runs_scored",
    ),
)
def sweep_symbol(spark, sf):
    return tidy(stress.sweep_symbols(inputs.momentum(spark, sf)))


@query(
    "break_even_cost",
    with_sql(
        _COST_RUNS,
        f"""SELECT symbol, {rounded('max(cost_bps) FILTER (beats_buy_and_hold)', 'break_even_cost_bps')}
FROM runs_scored GROUP BY symbol""",
    ),
)
def break_even_cost(spark, sf):
    swept = stress.sweep_costs(inputs.momentum(spark, sf), _COSTS)
    return tidy(stress.break_even_cost(swept))


_THRESHOLD_RUNS = f"{_grid_sql(_PRED, 'threshold', _THRESHOLDS)},\n" + sql.score_runs(
    "gridded", "symbol, threshold", "threshold", "7"
)


def _sweep_rows(chain: str, name: str, where: str = "") -> str:
    return f"""SELECT * FROM (WITH RECURSIVE {chain}
  SELECT symbol, '{name}' AS sweep, total_return, sharpe_ratio, beats_buy_and_hold FROM runs_scored {where})"""


_ROBUST = f"""swept AS (
  {_sweep_rows(_COST_RUNS, 'cost')} UNION ALL {_sweep_rows(_THRESHOLD_RUNS, 'threshold')}
  UNION ALL {_sweep_rows(_PERIODS, 'period', 'JOIN sizes USING (symbol, period) WHERE days >= 20')}),
robust AS (
  SELECT symbol, sweep, count(*) AS n_configurations, min(total_return) AS return_min,
    max(total_return) AS return_max, avg(total_return) AS return_mean,
    stddev_samp(total_return) AS return_std, min(sharpe_ratio) AS sharpe_min,
    max(sharpe_ratio) AS sharpe_max,
    avg(CASE WHEN beats_buy_and_hold THEN 100.0 WHEN NOT beats_buy_and_hold THEN 0.0 END) AS pct_beating_benchmark
  FROM swept GROUP BY symbol, sweep),
verdicts AS (
  SELECT symbol, avg(pct_beating_benchmark) AS mean_beat_rate, max(return_std) AS spread
  FROM robust GROUP BY symbol)"""


def _robust(spark, sf):
    predicted = inputs.momentum(spark, sf)
    return stress.robustness_summary({
        "cost": stress.sweep_costs(predicted, _COSTS),
        "threshold": stress.sweep_thresholds(predicted, _THRESHOLDS),
        "period": stress.sweep_periods(predicted),
    })


@query(
    "robustness_summary",
    with_sql(
        _ROBUST,
        f"""SELECT symbol, sweep, n_configurations, {num(
            'return_min', 'return_max', 'return_mean', 'return_std', 'sharpe_min', 'sharpe_max',
            'pct_beating_benchmark')} FROM robust""",
    ),
)
def robustness_summary(spark, sf):
    return tidy(_robust(spark, sf))


@query(
    "stress_verdict",
    with_sql(
        _ROBUST,
        f"""SELECT symbol, {num('mean_beat_rate')},
  CASE WHEN mean_beat_rate >= 75 THEN 'robust' WHEN mean_beat_rate >= 40 THEN 'mixed'
       ELSE 'no_edge' END AS verdict, coalesce(spread > 0.5, false) AS fragile FROM verdicts""",
    ),
)
def stress_verdict(spark, sf):
    return tidy(stress.stress_verdict(_robust(spark, sf)))


# ------------------------------------------------------------- walk-forward


def _folds_sql(mode: str) -> str:
    oldest = "0" if mode == "expanding" else "greatest(lo - 500, 0)"
    return f"""{_DATA},
spaced AS (
  SELECT symbol, date, row_number() OVER ({sql.SERIES}) - 1 AS pos,
         count(*) OVER (PARTITION BY symbol) AS n FROM data),
edges AS (
  SELECT symbol, n, CAST(fold AS INTEGER) AS fold,
    CAST(trunc((fold - 1) * ((n - 500) / 5.0) + 500) AS INTEGER) AS lo,
    CASE WHEN fold = 5 THEN n ELSE CAST(trunc(fold * ((n - 500) / 5.0) + 500) AS INTEGER) END AS hi
  FROM (SELECT DISTINCT symbol, n FROM spaced WHERE n - 500 >= 5), range(1, 6) f(fold)),
folds AS (
  SELECT e.symbol, e.fold,
    min(date) FILTER (pos >= {oldest} AND pos < lo) AS train_start,
    max(date) FILTER (pos >= {oldest} AND pos < lo) AS train_end,
    min(date) FILTER (pos >= lo AND pos < hi) AS test_start,
    max(date) FILTER (pos >= lo AND pos < hi) AS test_end,
    count(*) FILTER (pos >= {oldest} AND pos < lo) AS n_train,
    count(*) FILTER (pos >= lo AND pos < hi) AS n_test
  FROM edges e JOIN spaced s ON e.symbol = s.symbol GROUP BY e.symbol, e.fold)"""


@query("fold_table", with_sql(_folds_sql("expanding"), "SELECT * FROM folds"))
def fold_table(spark, sf):
    return walkforward.make_folds(_dataset(spark, sf))


@query("fold_table_rolling", with_sql(_folds_sql("rolling"), "SELECT * FROM folds"))
def fold_table_rolling(spark, sf):
    return walkforward.make_folds(_dataset(spark, sf), mode="rolling")


@query(
    "fold_skipped",
    with_sql(
        _DATA,
        """SELECT symbol, split, count(*) AS n_rows, 505::BIGINT AS needed FROM data
GROUP BY symbol, split HAVING count(*) < 505""",
    ),
)
def fold_skipped(spark, sf):
    """Symbol and part as series of their own: the short parts cannot be folded."""
    return walkforward.skipped(_dataset(spark, sf), keys=("symbol", "split"))


# -------------------------------------------------------------- evaluation

_LAGGED = f"""{_DATA},
scored AS (
  SELECT symbol, date, split, target AS t, ret_lag_1 AS p, CAST(target > 0 AS INTEGER) AS ty,
         CAST(ret_lag_1 > 0 AS INTEGER) AS py FROM data)"""
_REG = f"{_LAGGED},\n{sql.regression_record('scored', 'symbol, split')}"
_PAIR = ["symbol", "split"]


def _scored(spark, sf):
    return _dataset(spark, sf).withColumn("prediction", F.col("ret_lag_1"))


def _classes(spark, sf):
    return _scored(spark, sf).select(
        "symbol",
        "date",
        "split",
        (F.col("target") > 0).cast("double").alias("target"),
        (F.col("prediction") > 0).cast("double").alias("called"),
        "prediction",
    )


@query(
    "eval_regression",
    with_sql(_REG, f"SELECT symbol, split, n, {num(*sql.REG_NUMBERS)} FROM reg"),
)
def eval_regression(spark, sf):
    return tidy(evaluate.regression_metrics(_scored(spark, sf), keys=_PAIR))


@query(
    "eval_metrics_frame",
    with_sql(
        _REG,
        " UNION ALL ".join(
            f"SELECT symbol, split, '{m}' AS metric, {rounded(f'CAST({m} AS DOUBLE)', 'value')} FROM reg"
            for m in ("n", *sql.REG_NUMBERS)
        ),
    ),
)
def eval_metrics_frame(spark, sf):
    scored = evaluate.regression_metrics(_scored(spark, sf), keys=_PAIR)
    return tidy(evaluate.metrics_frame(scored, _PAIR))


@query(
    "eval_sanity_flags",
    with_sql(
        _REG,
        """SELECT symbol, split, concat_ws('; ', CASE WHEN r2 > 0.10 THEN 'r2 above 0.10' END,
  CASE WHEN directional_accuracy > 0.60 THEN 'directional accuracy above 0.60' END,
  CASE WHEN abs(information_coefficient) > 0.30 THEN 'absolute information coefficient above 0.30' END,
  CASE WHEN std_prediction < 1e-9 THEN 'constant prediction' END) AS flags FROM reg""",
    ),
)
def eval_sanity_flags(spark, sf):
    flagged = evaluate.sanity_flags(evaluate.regression_metrics(_scored(spark, sf), keys=_PAIR))
    return flagged.select(*_PAIR, F.concat_ws("; ", "flags").alias("flags"))


@query(
    "eval_pooled",
    with_sql(
        f"{_LAGGED},\n{sql.regression_record('scored', 'split')}",
        f"SELECT split, n, {num(*sql.REG_NUMBERS)} FROM reg",
    ),
)
def eval_pooled(spark, sf):
    """All symbols of a split in one group: ranks come from sorted ranges."""
    return tidy(evaluate.regression_metrics(_scored(spark, sf), keys=["split"]))


@query(
    "eval_auc_pooled",
    with_sql(
        _LAGGED,
        f"""SELECT split, {rounded('(sum(rk) FILTER (ty = 1) - sum(ty) * (sum(ty) + 1) / 2.0) / (sum(ty) * (count(*) - sum(ty)))', 'roc_auc')}
FROM (SELECT *, (rank() OVER (PARTITION BY split ORDER BY p) * 2 + count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS rk
  FROM scored) GROUP BY split""",
    ),
)
def eval_auc_pooled(spark, sf):
    return tidy(evaluate.roc_auc(_classes(spark, sf), "target", "prediction", ["split"]))


_AUC = """auc AS (
  SELECT symbol, split, (sum(rk) FILTER (ty = 1) - sum(ty) * (sum(ty) + 1) / 2.0)
    / nullif(sum(ty) * (count(*) - sum(ty)), 0) AS roc_auc
  FROM (SELECT *, (rank() OVER (PARTITION BY symbol, split ORDER BY p) * 2
          + count(*) OVER (PARTITION BY symbol, split, p) - 1) / 2.0 AS rk FROM scored)
  GROUP BY symbol, split)"""


@query(
    "eval_classification",
    with_sql(
        f"""{_LAGGED},
cells AS (
  SELECT symbol, split, count(*) AS n, count(*) FILTER (ty = 1 AND py = 1)::DOUBLE AS tp,
    count(*) FILTER (ty = 0 AND py = 1)::DOUBLE AS fp, count(*) FILTER (ty = 1 AND py = 0)::DOUBLE AS fn,
    avg(CAST(ty = py AS INTEGER)) AS accuracy, avg(ty) AS base_rate
  FROM scored GROUP BY symbol, split),
{_AUC}""",
        f"""SELECT symbol, split, n, {num('accuracy', 'base_rate', 'roc_auc')},
  {rounded('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
  {rounded('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {rounded('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}
FROM cells JOIN auc USING (symbol, split)""",
    ),
)
def eval_classification(spark, sf):
    return tidy(
        evaluate.classification_metrics(
            _classes(spark, sf), prediction="called", probability="prediction", keys=_PAIR
        )
    )


@query(
    "eval_auc",
    with_sql(f"{_LAGGED},\n{_AUC}", f"SELECT symbol, split, {num('roc_auc')} FROM auc"),
)
def eval_auc(spark, sf):
    return tidy(evaluate.roc_auc(_classes(spark, sf), "target", "prediction", _PAIR))


@query(
    "confusion",
    with_sql(
        _LAGGED,
        """SELECT symbol, split, CASE WHEN ty = 1 THEN 'up' ELSE 'down' END AS actual,
  count(*) FILTER (py = 0) AS predicted_down, count(*) FILTER (py = 1) AS predicted_up
FROM scored GROUP BY symbol, split, ty""",
    ),
)
def confusion(spark, sf):
    return evaluate.confusion(_classes(spark, sf), prediction="called", keys=_PAIR)


@query(
    "overfit_flag",
    with_sql(
        _REG,
        f"""SELECT symbol, {rounded("max(r2) FILTER (split = 'train')", 'train_r2')},
  {rounded("max(r2) FILTER (split = 'test')", 'test_r2')},
  max(r2) FILTER (split = 'train') - max(r2) FILTER (split = 'test') > 0.15 AS overfit
FROM reg GROUP BY symbol""",
    ),
)
def overfit_flag(spark, sf):
    return tidy(eda.overfit_flag(evaluate.regression_metrics(_scored(spark, sf), keys=_PAIR)))


# ------------------------------------------------------------------ models
#
# Ridge fits are solved again in SQL; for trees and logistic fits what is
# determined without the fit is compared, and tests cover the rest.

_PREDICTED = ("symbol", "date", "split", "target", "prediction")
_PREDICTIONS = f"SELECT symbol, date, split, {num('target', 'prediction')} FROM predicted"
_RIDGE = f"""{_DATA},
train AS (SELECT * FROM data WHERE split = 'train'),
{sql.ridge('train', 'symbol', FEATURES, 1.0)},
predicted AS (
  SELECT symbol, date, split, target, {sql.fitted(FEATURES)} AS prediction
  FROM data JOIN coefs USING (symbol))"""
_POOLED_RIDGE = f"""{_DATA},
pooled AS (SELECT *, 0 AS pool FROM data),
train AS (SELECT * FROM pooled WHERE split = 'train'),
{sql.ridge('train', 'pool', FEATURES, 1.0)},
predicted AS (
  SELECT symbol, date, split, target, {sql.fitted(FEATURES)} AS prediction
  FROM pooled JOIN coefs USING (pool))"""
#: Least squares has one set of fitted values, but not of weights: one input is the difference of two others.
_INDEPENDENT = [c for c in FEATURES if c != "macd_hist_norm"]
_POOLED_LINEAR = f"""{_DATA},
pooled AS (SELECT *, 0 AS pool FROM data),
train AS (SELECT * FROM pooled WHERE split = 'train'),
{sql.ridge('train', 'pool', _INDEPENDENT, 0.0)},
predicted AS (
  SELECT symbol, date, split, target, {sql.fitted(_INDEPENDENT)} AS prediction
  FROM pooled JOIN coefs USING (pool))"""
_WEIGHTS = (
    "(SELECT {keys}, unnest([" + ", ".join(f"'{c}'" for c in FEATURES) + "]) AS feature, "
    "unnest(weight) / list_sum(weight) AS importance FROM coefs)"
)
_WALKED = f"""{_folds_sql('expanding')},
numbered_rows AS MATERIALIZED (
  SELECT d.*, s.pos, e.fold, e.lo, e.hi FROM data d JOIN spaced s USING (symbol, date)
  JOIN edges e USING (symbol) WHERE s.pos < e.hi),
train AS (SELECT * FROM numbered_rows WHERE pos < lo),
{sql.ridge('train', 'symbol, fold', FEATURES, 1.0)},
walked AS MATERIALIZED (
  SELECT symbol, date, fold, close, target, target AS t, {sql.fitted(FEATURES)} AS prediction,
         {sql.fitted(FEATURES)} AS p
  FROM numbered_rows JOIN coefs USING (symbol, fold) WHERE pos >= lo)"""
_WALK = f"""{_WALKED},
{sql.regression_record('walked', 'symbol, fold')},
fold_rows AS (SELECT * FROM folds JOIN reg USING (symbol, fold))"""
_FOLD_METRICS = ("n_train", "n_test", *sql.REG_NUMBERS)


def _fitted(spark, sf, name, **params):
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    return data, study.train(data, SPEC, name, params=params)


def _model_query(name: str, model: str) -> None:
    solved = {"ridge": _POOLED_RIDGE, "linear": _POOLED_LINEAR}.get(model)

    @query(name, solved and with_sql(solved, _PREDICTIONS))
    def predictions(spark, sf):
        _, trained = _fitted(spark, sf, model)
        return tidy(trained.predictions.select(*_PREDICTED))


for _name in models.MODELS:
    _model_query(f"model_{_name}", _name)


@query("model_ridge_per_symbol", with_sql(_RIDGE, _PREDICTIONS))
def model_ridge_per_symbol(spark, sf):
    # read twice: by the fit and by the prediction
    data = study.checkpointed(_dataset(spark, sf))
    fitted = fit_linear(data.where("split = 'train'"), FEATURES, alpha=1.0)
    return tidy(predict_linear(data, fitted, FEATURES).select(*_PREDICTED))


@query("model_logistic")
def model_logistic(spark, sf):
    data = study.checkpointed(_dataset(spark, sf, "classification"))
    model = models.fit_model(
        data.where("split = 'train'"), FEATURES, "linear", task="classification"
    )
    return models.predict(model, data).select(*_PREDICTED, "probability")


@query(
    "feature_importance",
    with_sql(_RIDGE, f"SELECT symbol, feature, {num('importance')} FROM {_WEIGHTS.format(keys='symbol')}"),
)
def feature_importance(spark, sf):
    train = _dataset(spark, sf).where("split = 'train'")
    return tidy(linear_importance(fit_linear(train, FEATURES, alpha=1.0), FEATURES))


@query(
    "model_metrics",
    with_sql(
        f"""{_POOLED_RIDGE},
walked AS (SELECT symbol, split, target AS t, prediction AS p FROM predicted),
{sql.regression_record('walked', 'symbol, split')}""",
        f"SELECT symbol, split, n, {num(*sql.REG_NUMBERS)} FROM reg",
    ),
)
def model_metrics(spark, sf):
    _, trained = _fitted(spark, sf, "ridge")
    return tidy(study.model_metrics(trained.predictions, SPEC))


@query("model_compare")
def model_compare(spark, sf):
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    return study.compare_models(data, SPEC)


def _solved(model: str, names, alpha: float) -> str:
    """SQL of the pooled predictions of a least-squares model, as one select."""
    return f"""SELECT '{model}' AS model, symbol, date, split, target, close, prediction FROM (WITH RECURSIVE
pooled AS (SELECT *, 0 AS pool FROM data),
train AS (SELECT * FROM pooled WHERE split = 'train'),
{sql.ridge('train', 'pool', names, alpha)}
SELECT symbol, date, split, target, close, {sql.fitted(names)} AS prediction FROM pooled JOIN coefs USING (pool))"""


_COMPARED = f"""{_DATA},
stacked AS MATERIALIZED ({_solved('linear', _INDEPENDENT, 0.0)}
  UNION ALL {_solved('ridge', FEATURES, 1.0)}),
pred AS MATERIALIZED (
  SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol, model ORDER BY date) - 1, 0) AS asset_return,
         target AS t, prediction AS p
  FROM stacked WHERE split = 'test'),
{sql.score_runs('pred', 'symbol, model', '0', '7')},
{sql.regression_record('pred', 'symbol, model')},
market AS (SELECT symbol, date, asset_return AS r FROM pred WHERE model = 'linear'),
{sql.performance('market', 'symbol', 'hold_perf')},
compared AS MATERIALIZED (
  SELECT symbol, model, rmse, mae, r2, directional_accuracy, information_coefficient, total_return, cagr, sharpe_ratio,
         max_drawdown, CAST(n_trades AS BIGINT) AS n_trades, exposure
  FROM runs_scored JOIN reg USING (symbol, model)
  UNION ALL
  SELECT symbol, 'buy_and_hold', NULL, NULL, NULL, NULL, NULL, total_return, cagr, sharpe_ratio, max_drawdown, 1, 1.0
  FROM hold_perf)"""
_COMPARED_NUMBERS = (
    "rmse", "mae", "r2", "directional_accuracy", "information_coefficient", "total_return", "cagr", "sharpe_ratio",
    "max_drawdown", "exposure",
)


def _compared(spark, sf):
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    return study.compare_models(data, SPEC, ("linear", "ridge"))


@query(
    "model_compare_linear",
    with_sql(_COMPARED, f"SELECT symbol, model, n_trades, {num(*_COMPARED_NUMBERS)} FROM compared"),
)
def model_compare_linear(spark, sf):
    """What the comparison of models determines: least squares, ridge, and the market."""
    return tidy(_compared(spark, sf))


@query(
    "best_models_linear",
    with_sql(
        _COMPARED,
        # linear comes first where both tie, as they do when all signals agree
        """SELECT symbol, first(model ORDER BY round(sharpe_ratio, 9) DESC, model) FILTER (model <> 'buy_and_hold') AS best_sharpe,
  first(model ORDER BY round(total_return, 9) DESC, model) FILTER (model <> 'buy_and_hold') AS best_return,
  first(model ORDER BY rmse) FILTER (model <> 'buy_and_hold') AS lowest_rmse
FROM compared GROUP BY symbol""",
    ),
)
def best_models_linear(spark, sf):
    return eda.best_models(_compared(spark, sf))


@query(
    "model_logistic_gradient",
    with_sql(
        _DATA,
        "SELECT unnest(["
        + ", ".join(f"'{c}'" for c in ("intercept", *FEATURES))
        + "]) AS feature, n, 0.0::DOUBLE AS slope FROM (SELECT count(*) AS n FROM data WHERE split = 'train')",
    ),
)
def model_logistic_gradient(spark, sf):
    """Slope of the penalised loss per training row at the fitted weights, rounded: zero where the fit ended."""
    data = study.checkpointed(_dataset(spark, sf, "classification").where("split = 'train'"))
    return tidy(models.logistic_slopes(models.fit_model(data, FEATURES, "linear", task="classification"), data), 4)


@query(
    "model_tree_nodes",
    with_sql(
        _DATA,
        """SELECT model, symbol, split, count(*) AS n, count(*) AS agreeing
FROM data, (SELECT unnest(['boosted', 'random_forest']) AS model) GROUP BY ALL""",
    ),
)
def model_tree_nodes(spark, sf):
    """Fitted trees as a node table, walked by joins: for how many rows it gives what the model gives."""
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    out = None
    for name, size in (("random_forest", "trees"), ("boosted", "rounds")):
        model = models.fit_model(data.where("split = 'train'"), FEATURES, name, {size: 20})
        walked = models.score_nodes(models.tree_nodes(model, spark), model, data, ["symbol", "date"])
        both = models.predict(model, data).withColumnRenamed("prediction", "told").join(walked, ["symbol", "date"])
        part = both.groupBy(F.lit(name).alias("model"), "symbol", "split").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("told") - F.col("prediction")) < 1e-12).alias("agreeing")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("best_models")
def best_models(spark, sf):
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    return eda.best_models(study.compare_models(data, SPEC))


@query(
    "walk_forward",
    with_sql(_WALK, f"SELECT symbol, date, fold, {num('target', 'prediction')} FROM walked"),
)
def walk_forward(spark, sf):
    out, _ = walkforward.walk_forward(_dataset(spark, sf), FEATURES, "ridge")
    return tidy(out.select("symbol", "date", "fold", "target", "prediction"))


@query(
    "walk_forward_overall",
    with_sql(
        f"{_WALKED},\n{sql.regression_record('walked', 'symbol')}",
        f"SELECT symbol, n, {num(*sql.REG_NUMBERS)} FROM reg",
    ),
)
def walk_forward_overall(spark, sf):
    out, _ = walkforward.walk_forward(_dataset(spark, sf), FEATURES, "ridge")
    return tidy(walkforward.overall_metrics(out))


def _walked_folds(spark, sf):
    data = study.checkpointed(_dataset(spark, sf))
    out, _ = walkforward.walk_forward(data, FEATURES, "ridge")
    return walkforward.fold_table(out, walkforward.make_folds(data))


@query(
    "walk_forward_stability",
    with_sql(
        f"""{_WALK},
tall AS ({" UNION ALL ".join(
    f"SELECT symbol, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fold_rows" for m in _FOLD_METRICS)})""",
        f"""SELECT symbol, metric, {rounded('avg(value)', 'mean')}, {rounded('stddev_samp(value)', 'std')},
  {rounded('min(value)', 'min')}, {rounded('max(value)', 'max')} FROM tall GROUP BY symbol, metric""",
    ),
)
def walk_forward_stability(spark, sf):
    return tidy(walkforward.stability(_walked_folds(spark, sf)))


@query(
    "walk_forward_spread",
    with_sql(
        _WALK,
        f"""SELECT symbol, {rounded('avg(directional_accuracy)', 'mean')},
  {rounded('max(directional_accuracy) - min(directional_accuracy)', 'spread')},
  max(directional_accuracy) - min(directional_accuracy) > 0.10 AS unstable FROM fold_rows GROUP BY symbol""",
    ),
)
def walk_forward_spread(spark, sf):
    return tidy(eda.fold_spread(_walked_folds(spark, sf)))


@query(
    "walk_forward_importance",
    with_sql(
        _WALK,
        f"""SELECT symbol, feature, {rounded('avg(importance)', 'importance')}
FROM {_WEIGHTS.format(keys='symbol, fold')} GROUP BY symbol, feature""",
    ),
)
def walk_forward_importance(spark, sf):
    _, importance = walkforward.walk_forward(_dataset(spark, sf), FEATURES, "ridge")
    return tidy(walkforward.average_importance(importance))


@query(
    "walk_forward_backtest",
    with_sql(
        _comparison_sql(
            f"""{_WALKED},
stitched AS (
  SELECT *, coalesce(close / lag(close) OVER ({sql.SERIES}) - 1, 0) AS asset_return FROM walked),
{sql.backtest('stitched', short=False)}"""
        ),
        "SELECT symbol, metric, "
        + ", ".join(rounded(f"sign({c}) * ln(1 + abs({c}))", c) for c in ("strategy", "buy_and_hold", "difference"))
        + " FROM comparison",
    ),
)
def walk_forward_backtest(spark, sf):
    """On a logarithmic scale: without costs of scale the returns here reach 1e16."""
    out, _ = walkforward.walk_forward(_dataset(spark, sf), FEATURES, "ridge")
    table = metrics.compare_to_benchmark(walkforward.walk_forward_backtest(out))
    scaled = {
        c: F.signum(c) * F.log1p(F.abs(F.col(c))) for c in ("strategy", "buy_and_hold", "difference")
    }
    return tidy(table.withColumns(scaled))


def _range_sql(source: str) -> str:
    return f"""{_DATA},
labelled AS ({source}),
bounds AS (SELECT min(target) AS lo, max(target) AS hi FROM labelled WHERE split = 'train')"""


def _fit_check(name: str, fit, source: str, inside: str) -> None:
    """A query on what is determined without the fit: rows, targets, and that all
    predictions are known and lie where the model can put them."""

    @query(
        name,
        with_sql(
            _range_sql(source),
            f"""SELECT symbol, split, count(*) AS n, {rounded('avg(target)', 'mean_target')},
  count(*) AS n_inside, count(*) AS n_known FROM labelled GROUP BY symbol, split""",
        ),
    )
    def check(spark, sf):
        out = fit(spark, sf)
        train = F.when(F.col("split") == "train", F.col("target"))
        lo, hi = out.agg(F.min(train), F.max(train)).first()
        p = F.col("prediction")
        fits = F.expr(inside.format(lo=repr(lo), hi=repr(hi)))
        return tidy(
            out.groupBy("symbol", "split").agg(
                F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_target"),
                F.count_if(fits).alias("n_inside"), F.count_if(p.isNotNull() & ~F.isnan(p)).alias("n_known"),
            )
        )


_REGRESSED = "SELECT symbol, date, split, target FROM data"
_CLASSED = "SELECT symbol, date, split, CAST(target > 0 AS DOUBLE) AS target FROM data"


def _classified(name: str):
    def fit(spark, sf):
        data = study.checkpointed(_dataset(spark, sf, "classification"))
        model = models.fit_model(data.where("split = 'train'"), FEATURES, name, task="classification")
        return models.predict(model, data)

    return fit


# A forest averages training targets, so it cannot leave their range.
_fit_check(
    "model_forest_range", lambda spark, sf: _fitted(spark, sf, "random_forest")[1].predictions, _REGRESSED,
    "prediction BETWEEN {lo}D AND {hi}D",
)
_fit_check(
    "model_boosted_known", lambda spark, sf: _fitted(spark, sf, "boosted")[1].predictions, _REGRESSED,
    "abs(prediction) < 1",
)
for _name in ("linear", "random_forest", "boosted"):
    _fit_check(
        f"model_{_name}_classes", _classified(_name), _CLASSED,
        "prediction IN (0.0D, 1.0D) AND (prediction = 1.0D) = (probability > 0.5D)",
    )


def _basket(name: str):
    def fit(spark, sf):
        data = study.checkpointed(_dataset(spark, sf))
        symbols = sorted(r[0] for r in data.select("symbol").distinct().collect())
        fitted = models.fit_basket(data.where("split = 'train'"), FEATURES, symbols, name=name)
        return models.predict_basket(fitted, data)

    return fit


_fit_check("model_basket_forest", _basket("random_forest"), _REGRESSED, "prediction BETWEEN {lo}D AND {hi}D")
_fit_check("model_basket_boosted", _basket("boosted"), _REGRESSED, "abs(prediction) < 1")


@query(
    "model_importance_sums",
    with_sql(
        "names AS (SELECT unnest(['random_forest', 'boosted', 'ridge']) AS model)",
        f"SELECT model, {len(FEATURES)}::BIGINT AS n_features, 1.0::DOUBLE AS total FROM names",
    ),
)
def model_importance_sums(spark, sf):
    """Importance covers every feature and sums to one, whatever the fit."""
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    out = None
    for name in ("random_forest", "boosted", "ridge"):
        part = study.train(data, SPEC, name).importance.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query("sweep_seed")
def sweep_seed(spark, sf):
    data = study.prepare(inputs.trade_bars(spark, sf), SPEC)
    stacked = study.seed_predictions(data, SPEC, "random_forest")
    return stress.sweep_seeds(stacked)


# -------------------------------------------------------------------- live

_LOG = f"""{_PRED},
log AS (
  SELECT symbol, date AS bar_date, 'momentum' AS model, prediction,
         CASE WHEN prediction > 0.01 THEN 1.0::DOUBLE WHEN prediction < -0.01 THEN -1.0::DOUBLE
              ELSE 0.0::DOUBLE END AS signal
  FROM pred WHERE prediction IS NOT NULL),
nexts AS (
  SELECT symbol, date AS bar_date, lead(date) OVER ({sql.SERIES}) AS target_date,
         lead(asset_return) OVER ({sql.SERIES}) AS realised_return FROM pred),
scored AS (
  SELECT log.*, target_date, realised_return,
    CASE WHEN target_date IS NULL THEN NULL WHEN signal = 0 THEN 'flat'
         WHEN sign(signal) = sign(realised_return) THEN 'True' ELSE 'False' END AS correct
  FROM log JOIN nexts USING (symbol, bar_date))"""


def _log(spark, sf):
    bars = inputs.momentum(spark, sf)
    log = bars.where(F.col("prediction").isNotNull()).select(
        F.col("date").alias("bar_date"),
        F.lit(None).cast("date").alias("target_date"),
        "symbol",
        F.lit("momentum").alias("model"),
        F.lit(SPEC.fingerprint()).alias("fingerprint"),
        "prediction",
        signals.signal_of("prediction", BAND, True).alias("signal"),
        F.lit(None).cast("double").alias("realised_return"),
        F.lit(None).cast("string").alias("correct"),
        F.col("date").cast("timestamp").alias("logged_at"),
    )
    return log, bars


@query(
    "log_backfill",
    with_sql(
        _LOG,
        f"""SELECT symbol, bar_date, model, target_date, {num('prediction', 'signal', 'realised_return')},
  correct FROM scored""",
    ),
)
def log_backfill(spark, sf):
    done = live.backfill_outcomes(*_log(spark, sf))
    return tidy(done.drop("fingerprint", "logged_at"))


@query(
    "log_scorecard",
    with_sql(
        _LOG,
        f"""SELECT symbol, count(*) AS n_predictions, count(realised_return) AS n_scored,
  count(*) FILTER (correct IN ('True', 'False')) AS n_directional,
  {rounded("avg(CASE correct WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 END)", 'hit_rate')},
  {rounded('product(1 + signal * realised_return) - 1', 'strategy_return')},
  {rounded('product(1 + realised_return) - 1', 'buy_and_hold_return')},
  {rounded('avg(prediction) FILTER (realised_return IS NOT NULL)', 'mean_prediction')},
  min(bar_date) FILTER (realised_return IS NOT NULL) AS first_date,
  max(bar_date) FILTER (realised_return IS NOT NULL) AS last_date FROM scored GROUP BY symbol""",
    ),
)
def log_scorecard(spark, sf):
    return tidy(live.scorecard(live.backfill_outcomes(*_log(spark, sf))))


@query(
    "log_idempotent_append",
    with_sql(
        _LOG,
        f"""SELECT symbol, bar_date, model, {num('prediction', 'signal')} FROM log
WHERE bar_date > DATE '2000-06-30'""",
    ),
)
def log_idempotent_append(spark, sf):
    log, _ = _log(spark, sf)
    fresh = live.unlogged(log, log.where("bar_date <= DATE '2000-06-30'"))
    return tidy(fresh.select("symbol", "bar_date", "model", "prediction", "signal"))


@query(
    "live_latest_ridge",
    with_sql(
        _RIDGE,
        f"""SELECT symbol, date, {rounded(sql.fitted(FEATURES), 'prediction')}
FROM feat JOIN coefs USING (symbol) QUALIFY date = max(date) OVER (PARTITION BY symbol)""",
    ),
)
def live_latest_ridge(spark, sf):
    """Tomorrow's prediction from the tail of each symbol, under its own ridge fit."""
    bars = study.checkpointed(inputs.trade_bars(spark, sf))
    data = target.attach_target(build_features(bars))
    train = target.chronological_split(data, SPEC.train_end, SPEC.valid_end).where("split = 'train'")
    latest = live.latest_features(bars, SPEC)
    fitted = fit_linear(train, FEATURES, alpha=1.0)
    return tidy(predict_linear(latest, fitted, FEATURES).select("symbol", "date", "prediction"))


@query(
    "live_predictions",
    with_sql(
        _POOLED_RIDGE,
        f"""SELECT symbol, date AS bar_date, 'ridge' AS model, {rounded('20 * p', 'prediction')},
  CASE WHEN 20 * p > 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal, abs(20 * p) > 0.10 AS refused
FROM (SELECT symbol, date, {sql.fitted(FEATURES)} AS p FROM feat, coefs QUALIFY date = max(date) OVER (PARTITION BY symbol))""",
    ),
)
def live_predictions(spark, sf):
    """Log rows of the newest bars under a stored model of twenty times the return, which the bound refuses in part."""
    spec = replace(SPEC, model="ridge", threshold=0.01)
    bars = study.checkpointed(inputs.trade_bars(spark, sf))
    train = study.prepare(bars, spec).where("split = 'train'").withColumn("target", F.col("target") * 20)
    path = models.model_path(_new_store(spark, "models"), "pool", "ridge", spec.fingerprint())
    models.save_model(models.fit_model(train, FEATURES, "ridge"), path)
    made = live.predict_latest(bars, models.load_model(path), spec, "2002-01-01 00:00:00")
    return tidy(made.select("symbol", "bar_date", "model", "prediction", "signal", "refused"))


@query(
    "incremental_features",
    with_sql(_FEAT, f"SELECT symbol, date, {num(*FEATURES, digits=8)} FROM feat WHERE date > DATE '2000-12-31'"),
)
def incremental_features(spark, sf):
    """Features of the test year in three batches from a state per symbol; no older bar is read again."""
    bars = study.checkpointed(inputs.trade_bars(spark, sf))
    kept = study.checkpointed(state.feature_state(bars.where("date <= DATE '2000-12-31'")))
    out = None
    for lo, hi in (("2001-01-01", "2001-03-31"), ("2001-04-01", "2001-08-31"), ("2001-09-01", "2002-12-31")):
        rows, after = state.advance(kept, bars.where(F.col("date").between(lo, hi)))
        kept = study.checkpointed(after)
        out = rows if out is None else out.unionByName(rows)
    return tidy(out, 8)


@query(
    "log_csv_round_trip",
    with_sql(
        _LOG,
        f"SELECT symbol, bar_date, model, {num('prediction', 'signal')}, CAST(NULL AS VARCHAR) AS correct FROM log",
    ),
)
def log_csv_round_trip(spark, sf):
    """The log through CSV text and back on its declared types."""
    log, _ = _log(spark, sf)
    text = log.select("symbol", "bar_date", "model", "prediction", "signal")
    path = logs.write_csv(text, _new_store(spark, "log-csv"))
    return tidy(
        logs.read_csv_log(spark, path).select("symbol", "bar_date", "model", "prediction", "signal", "correct")
    )


@query(
    "experiment_log",
    with_sql(
        f"""{_REG},
hold AS (SELECT symbol, count(*) AS bars FROM data GROUP BY symbol)""",
        f"""SELECT symbol, CAST(horizon AS INTEGER) AS horizon, 'boosted' AS model, n AS model_n,
  {rounded('mae', 'model_mae')}, bars AS strategy_bars, horizon = 1 AS has_note
FROM reg JOIN hold USING (symbol), (VALUES (1), (5)) h(horizon) WHERE split = 'test'""",
    ),
)
def experiment_log(spark, sf):
    """Two runs with different columns, the first logged twice."""
    path = _new_store(spark, "experiments")
    scored = study.checkpointed(_scored(spark, sf).select("symbol", "split", "target", "prediction"))
    accuracy = evaluate.regression_metrics(scored.where("split = 'test'")).select("symbol", "n", "mae")
    bars = scored.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    for horizon in (1, 1, 5):
        spec = replace(SPEC, horizon=horizon)
        row = logs.experiment_row(spec, accuracy, bars)
        if horizon == 1:
            row = row.withColumn("note", F.lit("again"))
        logs.log_experiment(row, path, spec.fingerprint())
    out = logs.read_experiments(spark, path)
    return tidy(
        out.select(
            "symbol", "horizon", "model", "model_n", "model_mae", "strategy_bars",
            F.col("note").isNotNull().alias("has_note"),
        )
    )


_NOW = "2001-06-15 19:30:00"  # 15:30 in New York: the session is still open


@query(
    "bar_finality",
    with_sql(
        sql.trade_bars(),
        "SELECT symbol, date, date < DATE '2001-06-15' AS is_final FROM bars",
    ),
)
def bar_finality(spark, sf):
    bars = inputs.trade_bars(spark, sf)
    return bars.select("symbol", "date", live.bar_is_final("date", _NOW).alias("is_final"))


@query(
    "live_equity",
    with_sql(
        _LOG,
        f"""SELECT symbol, bar_date, {rounded(sql.running('product', '1 + signal * realised_return',
            'PARTITION BY symbol ORDER BY bar_date'), 'strategy_equity')},
  {rounded(sql.running('product', '1 + realised_return', 'PARTITION BY symbol ORDER BY bar_date'),
           'benchmark_equity')},
  CASE WHEN signal > 0 THEN 'LONG' WHEN signal < 0 THEN 'SHORT' ELSE 'FLAT' END AS direction
FROM scored WHERE realised_return IS NOT NULL""",
    ),
)
def live_equity(spark, sf):
    out = live.with_direction(live.live_equity(live.backfill_outcomes(*_log(spark, sf))))
    return tidy(out.select("symbol", "bar_date", "strategy_equity", "benchmark_equity", "direction"))


# ---------------------------------------------------------------- explore

_MOVES = f"""{sql.trade_bars()},
moves AS (SELECT *, close / lag(close) OVER ({sql.SERIES}) - 1 AS ret FROM bars)"""


def _moves(spark, sf):
    return eda.with_returns(inputs.trade_bars(spark, sf))


@query(
    "return_statistics",
    with_sql(
        _MOVES,
        f"""SELECT symbol, {rounded('avg(ret)', 'mean')}, {rounded('stddev_samp(ret)', 'std')},
  {rounded('skewness(ret)', 'skew')}, {rounded('kurtosis(ret)', 'kurtosis')},
  {rounded('avg(CAST(ret > 0 AS INTEGER))', 'up_share')}, {rounded('max(ret)', 'best')},
  {rounded('min(ret)', 'worst')} FROM moves GROUP BY symbol""",
    ),
)
def return_statistics(spark, sf):
    return tidy(eda.return_statistics(_moves(spark, sf)))


@query(
    "return_histogram",
    with_sql(
        f"""{_MOVES},
spans AS (
  SELECT symbol, min(ret) AS lo, max(ret) AS hi, count(ret) AS n,
         (max(ret) - min(ret)) / 80 AS width FROM moves GROUP BY symbol),
binned AS (
  SELECT symbol, lo, n, width, CAST(least(floor((ret - lo) / width), 79) AS INTEGER) AS bin
  FROM moves JOIN spans USING (symbol) WHERE ret IS NOT NULL)""",
        f"""SELECT symbol, CAST(g.bin AS INTEGER) AS bin, {rounded('min(lo + g.bin * width)', 'left_edge')},
  {rounded('min(width)', 'width', 8)}, count(b.bin) AS count,
  {rounded('count(b.bin) / min(s.n * s.width)', 'density')}
FROM spans s CROSS JOIN range(80) g(bin)
LEFT JOIN (SELECT symbol, bin FROM binned) b USING (symbol, bin) GROUP BY symbol, g.bin""",
    ),
)
def return_histogram(spark, sf):
    out = eda.return_histogram(_moves(spark, sf))
    return out.select(
        "symbol", "bin", "count",
        *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("left_edge", 6), ("width", 8), ("density", 6))],
    )


@query(
    "normal_density",
    with_sql(
        f"""{_MOVES},
fits AS (
  SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd, min(ret) AS lo, max(ret) AS hi
  FROM moves GROUP BY symbol),
points AS (
  SELECT symbol, mu, sd, CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 299 AS x
  FROM fits, range(0, 300) g(i))""",
        f"""SELECT symbol, i, {num('x')},
  {rounded('exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * sqrt(2 * pi()))', 'density')} FROM points""",
    ),
)
def normal_density(spark, sf):
    return tidy(eda.normal_density(_moves(spark, sf)))


@query(
    "rolling_volatility",
    with_sql(
        _MOVES,
        f"""SELECT symbol, date, {rounded(f"({sql.roll('stddev_samp', 'ret', 20)}) * sqrt(252)",
            'volatility_20')},
  {rounded(f"({sql.roll('stddev_samp', 'ret', 60)}) * sqrt(252)", 'volatility_60')} FROM moves""",
    ),
)
def rolling_volatility(spark, sf):
    out = eda.rolling_volatility(_moves(spark, sf))
    return tidy(out.select("symbol", "date", "volatility_20", "volatility_60"))


@query(
    "cumulative_return",
    with_sql(
        _MOVES,
        f"""SELECT symbol, date, {rounded(sql.running('product', '1 + coalesce(ret, 0)') + ' - 1',
            'cumulative_return')} FROM moves""",
    ),
)
def cumulative_return(spark, sf):
    return tidy(eda.cumulative_return(_moves(spark, sf)).select("symbol", "date", "cumulative_return"))


@query(
    "price_averages",
    with_sql(
        _MOVES,
        "SELECT symbol, date, "
        + ", ".join(rounded(sql.roll("avg", "close", n), f"sma_{n}", 9) for n in (20, 50, 200))
        + " FROM moves",
    ),
)
def price_averages(spark, sf):
    out = eda.price_with_averages(inputs.trade_bars(spark, sf))
    return tidy(out.select("symbol", "date", "sma_20", "sma_50", "sma_200"), 9)


@query(
    "volume_view",
    with_sql(
        _MOVES,
        f"""SELECT symbol, date, {rounded(sql.roll('avg', 'volume', 20), 'volume_mean')},
  close >= open AS rising FROM moves""",
    ),
)
def volume_view(spark, sf):
    out = eda.volume_view(inputs.trade_bars(spark, sf))
    return tidy(out.select("symbol", "date", "volume_mean", "rising"))


@query(
    "last_rows",
    with_sql(
        sql.trade_bars("p_brand"),
        f"""SELECT symbol, date, {_BAR_NUMBERS} FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 15""",
    ),
)
def last_rows(spark, sf):
    return tidy(eda.last_rows(inputs.trade_bars(spark, sf, "p_brand"), 15))


# ----------------------------------------------------------------- report


@query(
    "verdict",
    with_sql(
        f"""{_COMPARISON},
diffs AS (
  SELECT symbol, max(difference) FILTER (metric = 'total_return') AS return_difference,
    max(difference) FILTER (metric = 'sharpe_ratio') AS sharpe_difference,
    max(difference) FILTER (metric = 'max_drawdown') AS drawdown_difference
  FROM comparison GROUP BY symbol)""",
        f"""SELECT symbol, {num('return_difference', 'sharpe_difference', 'drawdown_difference')},
  CASE WHEN return_difference IS NULL THEN 'inconclusive'
       WHEN return_difference > 0 AND coalesce(sharpe_difference > 0, false) THEN 'outperformed'
       WHEN return_difference > 0 THEN 'more_return_more_risk'
       WHEN coalesce(drawdown_difference > 0, false) THEN 'less_return_less_drawdown'
       ELSE 'did_not_beat' END AS verdict FROM diffs""",
    ),
)
def verdict(spark, sf):
    return tidy(report.verdict(metrics.compare_to_benchmark(_result(spark, sf))))


@query(
    "report_texts",
    with_sql(
        f"""{_DATA},
parts AS (SELECT symbol, split, count(*) AS rows, min(date) AS start, max(date) AS "end",
  round(count(*) / 252.0, 2)::DOUBLE AS years FROM data GROUP BY symbol, split),
lines AS (
  SELECT symbol, split || '/rows: ' || rows AS line FROM parts UNION ALL SELECT symbol, split || '/start: ' || start FROM parts
  UNION ALL SELECT symbol, split || '/end: ' || "end" FROM parts UNION ALL SELECT symbol, split || '/years: ' || years FROM parts)""",
        """SELECT symbol, '## splits' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS report FROM lines GROUP BY symbol""",
    ),
)
def report_texts(spark, sf):
    """The text of a report section per symbol."""
    sections = report.report_sections({"splits": target.split_summary(_dataset(spark, sf))})
    return report.report_text(sections)


@query(
    "report_backtest",
    with_sql(
        _COMPARISON,
        "SELECT symbol, 'comparison' AS section, metric || '/' || side AS item, round(value, 6) + 0.0 AS value FROM (UNPIVOT "
        "(SELECT symbol, metric, strategy, buy_and_hold, difference FROM comparison) "
        "ON strategy, buy_and_hold, difference INTO NAME side VALUE value)",
    ),
)
def report_backtest(spark, sf):
    """The comparison section of the report on a finished backtest, read back as numbers."""
    sections, _ = study.backtest_report(_result(spark, sf), SPEC)
    rows = sections.where("section = 'comparison'").withColumn("value", F.col("value").cast("double"))
    return tidy(rows.where("value IS NOT NULL"))


@query(
    "backtest_aligned",
    with_sql(
        f"""{_PRED},
shared AS (SELECT * FROM pred WHERE week(date) % 3 <> 0),
{sql.backtest("shared", short=False)}""",
        f"SELECT symbol, date, {num('asset_return', 'signal', 'position', 'cost', 'strategy_return', 'equity')} FROM bt",
    ),
)
def backtest_aligned(spark, sf):
    """Signals that lack every third week, on the dates they share with the bars."""
    bars = inputs.momentum(spark, sf)
    made = signals.generate_signals(bars, "prediction", 0.0, False).where(F.weekofyear("date") % 3 != 0)
    out = study.backtest_signals(bars, made, SPEC)
    return tidy(out.select("symbol", "date", "asset_return", "signal", "position", "cost", "strategy_return", "equity"))


@query(
    "asof_bars",
    with_sql(
        sql.trade_bars(),
        f"""SELECT l.symbol, l.date, r.date AS found_date, {rounded('r.close', 'found_close')}, n.date AS next_date
FROM bars l ASOF LEFT JOIN (SELECT * FROM bars WHERE week(date) % 3 = 0) r ON l.symbol = r.symbol AND l.date >= r.date
ASOF LEFT JOIN (SELECT * FROM bars WHERE week(date) % 5 = 0) n ON l.symbol = n.symbol AND l.date < n.date""",
    ),
)
def asof_bars(spark, sf):
    """Each bar with the last one of every third week up to it and the first one of every fifth week after it."""
    bars = inputs.trade_bars(spark, sf).select("symbol", "date", "close")
    week = F.weekofyear("date")
    past = asof_join(bars, bars.where(week % 3 == 0), ["symbol"], "date", name="found")
    both = asof_join(past, bars.where(week % 5 == 0), ["symbol"], "date", forward=True, exact=False, name="next")
    return tidy(
        both.select("symbol", "date", F.col("found.date").alias("found_date"), F.col("found.close").alias("found_close"),
                    F.col("next.date").alias("next_date"))
    )


@query(
    "feature_matrix_bucketed",
    with_sql(_FEAT, f"SELECT symbol, date, {num(*FEATURES, digits=8)} FROM feat"),
)
def feature_matrix_bucketed(spark, sf):
    """The feature matrix of a panel stored by symbol: its windows need no exchange."""
    stored = bucketed(inputs.trade_bars(spark, sf), "symbol", 16)
    return tidy(feature_matrix(build_features(stored)), 8)


@query("report_sections")
def report_sections(spark, sf):
    """The report of the ridge study per symbol, walk-forward included."""
    raw = inputs.raw_bars(spark, sf)
    out = study.run_full_study(raw, SPEC, "ridge", per_symbol=True)
    return out["sections"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Does weekly momentum beat buy-and-hold after costs, per symbol?"""
    return benchmark_comparison(spark, sf)
