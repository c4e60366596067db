import numpy as np
import pandas as pd
import pytest

from barloom.functions.windows import previous_in_arrival
from barloom.operators.cleaning import adjust_ohlc, clean, cleaning_log, mark_cleaning
from barloom.operators.quality import validate, validate_and_clean
from barloom.sources.raw_bars import LoadError, normalise, wide_to_long
from tests.frames import linear_bars, local, to_spark


def _checks(spark, pdf, **kw):
    return {r["check"]: r for r in validate(to_spark(spark, pdf, seq=True), **kw).collect()}


def _set(column, value, row=10):
    def change(pdf):
        pdf.loc[row, column] = value
        return pdf

    return change


def _swap(pdf):
    pdf.loc[[10, 11], :] = pdf.loc[[11, 10], :].to_numpy()
    return pdf


@pytest.mark.parametrize(
    "damage, check, severity, count",
    [
        (_set("close", None), "missing_values", "error", 1),
        (_set("open", float("inf")), "infinite_values", "error", 1),
        (_set("low", -1.0), "nonpositive_prices", "error", 1),
        (_set("volume", -5.0), "negative_volume", "error", 1),
        (_set("high", 1.0), "high_below_low", "error", 1),
        (_set("close", 500.0), "ohlc_inconsistent", "error", 1),
        (_set("volume", 0.0), "zero_volume", "warning", 1),
        (_set("adj_close", 300.0), "extreme_returns", "warning", 2),
        (lambda p: pd.concat([p, p.iloc[[59]]], ignore_index=True), "duplicate_dates", "error", 2),
        (_swap, "date_ordering", "error", 1),
        (lambda p: p.drop(index=range(20, 40)), "calendar_gaps", "warning", 20),
        (lambda p: p.drop(index=[20]), "calendar_gaps", "info", 1),
    ],
)
def test_each_check_fires_on_its_own_damage(spark, damage, check, severity, count):
    found = _checks(spark, damage(linear_bars()))
    assert found[check]["severity"] == severity
    assert found[check]["count"] == count


def test_sound_bars_have_no_findings(spark):
    assert _checks(spark, linear_bars()) == {}


def test_expected_symbols_without_rows(spark):
    want = spark.createDataFrame([("AAA",), ("ZZZ",)], "symbol string")
    found = validate(to_spark(spark, linear_bars(), seq=True), expected=want).collect()
    assert [(r["symbol"], r["check"]) for r in found] == [("ZZZ", "empty")]


def test_arrival_scan_is_exact_over_chunks(spark):
    rng = np.random.default_rng(3)
    pdf = linear_bars(200)
    pdf["adj_close"] = np.where(rng.uniform(size=200) < 0.5, np.nan, rng.uniform(1, 9, 200))
    df = previous_in_arrival(to_spark(spark, pdf, seq=True), ["adj_close"], chunk=7)
    got = local(df, "ingest_seq")["prev_adj_close"].astype(float)
    want = pdf["adj_close"].ffill().shift(1)
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_short_and_long_price_gaps(spark):
    one, many, volume = linear_bars(), linear_bars(), linear_bars()
    one.loc[10, "close"] = None
    many.loc[10:19, "close"] = None
    volume.loc[10, "volume"] = None
    assert len(local(clean(to_spark(spark, one, seq=True)))) == 60
    # Rows 10-12 are filled, but the stale close of 11 and 12 leaves their range.
    kept = local(clean(to_spark(spark, many, seq=True)), "date")
    assert len(kept) == 51
    assert len(local(clean(to_spark(spark, volume, seq=True)))) == 59


def test_cleaning_log_counts(spark):
    pdf = linear_bars()
    pdf.loc[5, "open"] = float("inf")
    pdf.loc[8, "low"] = -1.0
    pdf.loc[12, "volume"] = -1.0
    pdf.loc[20, "high"] = 1.0
    pdf = pd.concat([pdf, pdf.iloc[[30]].assign(close=120.0)], ignore_index=True)
    row = cleaning_log(mark_cleaning(to_spark(spark, pdf, seq=True))).first()
    assert (row["rows_before"], row["duplicates_dropped"]) == (61, 1)
    assert (row["infinite_to_missing"], row["nonpositive_to_missing"]) == (1, 1)
    assert (row["negative_volume_to_missing"], row["missing_dropped"]) == (1, 1)
    assert row["prices_filled"] == 2
    assert row["rows_after"] == 60 - row["missing_dropped"] - row["impossible_dropped"]


def test_cleaning_resolves_errors(spark):
    pdf = linear_bars()
    pdf.loc[5, "close"] = None
    pdf.loc[20, "high"] = 1.0
    _, before, after, _ = validate_and_clean(to_spark(spark, pdf, seq=True))
    assert {r["severity"] for r in before.collect()} >= {"error"}
    assert "error" not in {r["severity"] for r in after.collect()}


def test_adjustment_scales_all_prices_alike(spark):
    pdf = linear_bars(5).assign(adj_close=lambda p: p["close"] * 0.25)
    out = local(adjust_ohlc(to_spark(spark, pdf)), "date")
    np.testing.assert_allclose(out["high"], pdf["high"] * 0.25)
    np.testing.assert_allclose(out["close"], pdf["adj_close"])
    np.testing.assert_allclose(out["volume"], pdf["volume"])


def test_normalise_names_types_and_latest(spark):
    df = spark.createDataFrame(
        [("2024-01-02", "1", "2", "0.5", "x", "10", 0), ("2024-01-02", "1", "2", "0.5", "1.5", "11", 1)],
        "Date string, Open string, HIGH string, low string, ` Close` string, Volume string, ingest_seq bigint",
    )
    rows = normalise(df, symbol="abc").collect()
    assert len(rows) == 1
    assert (rows[0]["symbol"], rows[0]["close"], rows[0]["adj_close"]) == ("ABC", 1.5, 1.5)
    with pytest.raises(LoadError):
        normalise(df.drop("Volume"), symbol="abc")


def test_wide_header_to_long(spark):
    df = spark.createDataFrame(
        [("2024-01-02", 1.0, 2.0, 3.0, 4.0)],
        "date string, `Close|AAA` double, `Open|AAA` double, `Close|BBB` double, `Open|BBB` double",
    )
    got = {r["symbol"]: (r["open"], r["close"]) for r in wide_to_long(df).collect()}
    assert got == {"AAA": ("2.0", "1.0"), "BBB": ("4.0", "3.0")}


def test_newer_file_wins_whatever_its_size(spark, tmp_path):
    """Tasks read large files first; arrival is by change time of the file."""
    import os

    from barloom.sources.raw_bars import normalise, read_raw, unreadable_dates

    head = "date,open,high,low,close,volume,symbol\n"
    rows = "".join(f"2024-02-{d:02d},1,2,1,2,10,AAA\n" for d in range(1, 29))
    small, large = tmp_path / "small.csv", tmp_path / "large.csv"
    small.write_text(head + "2024-01-02,100,100,100,100,1,AAA\n2024-01-02,101,101,101,101,1,AAA\nnever,1,1,1,1,1,AAA\n")
    large.write_text(head + rows + "2024-01-02,200,200,200,200,1,AAA\n")
    for first, second, want in ((small, large, 200.0), (large, small, 101.0)):
        os.utime(first, (1_000_000, 1_000_000))
        os.utime(second, (2_000_000, 2_000_000))
        raw = read_raw(spark, [str(large), str(small)], "csv")
        numbers = sorted(r[0] for r in raw.select("ingest_seq").collect())
        assert numbers == list(range(32))
        day = normalise(raw).where("date = DATE '2024-01-02'").first()
        assert day["close"] == want
        assert unreadable_dates(raw).count() == 1


def test_ticks_keep_negative_and_large_prices(spark):
    from barloom.sources.ticks import bars_from_ticks

    ticks = spark.createDataFrame(
        [("A", 1, -5.0), ("A", 2, 7.0), ("B", 1, 2e9), ("B", 2, -3e11), ("C", -4, 1.5), ("C", 3, -2.5)],
        "symbol string, seq bigint, price double",
    ).selectExpr("symbol", "TIMESTAMP '2024-01-02 10:00:00' AS ts", "seq", "price", "1.0D AS volume")
    got = {r["symbol"]: (r["open"], r["high"], r["low"], r["close"]) for r in bars_from_ticks(ticks).collect()}
    assert got == {"A": (-5, 7, -5, 7), "B": (2e9, 2e9, -3e11, -3e11), "C": (1.5, 1.5, -2.5, -2.5)}
