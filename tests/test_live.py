import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.config import StudySpec
from barloom.operators.features import FEATURES, build_features, look_back
from barloom.operators.models import fit_model, save_model
from barloom.operators.target import attach_target
from barloom.sources import panel_store as store
from barloom.sources.logs import LOG_SCHEMA, coerce_log, read_log
from barloom.streaming.ingest import ingest_bars, merge_increment
from barloom.operators.cleaning import clean
from barloom.streaming.live import bar_is_final, latest_features, next_bars, recent, recent_bars, run_daily, scorecard
from tests.frames import BARS, linear_bars, local, to_spark, walk


def test_newest_revision_wins_and_repeats_are_harmless(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(20)
    store.write_batch(to_spark(spark, pdf.iloc[:15]), root, 0)
    revised = pdf.iloc[12:].assign(volume=2e6)
    for _ in range(2):
        merge_increment(spark, to_spark(spark, revised), root, 1)
    bars = local(store.read_panel(spark, root, ["aaa"]), "date")
    assert len(bars) == 20
    assert (bars["volume"] == [1e6] * 12 + [2e6] * 8).all()
    assert store.read_panel(spark, root, ["ZZZ"]).isEmpty()


def test_moved_basis_reloads_the_whole_history(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(20)
    rebased = pdf.assign(adj_close=pdf["close"] * 0.95)
    store.write_batch(to_spark(spark, pdf), root, 0)
    full = to_spark(spark, rebased)
    moved = merge_increment(
        spark, to_spark(spark, rebased.iloc[15:]), root, 1,
        full_history=lambda symbols: full.join(symbols, "symbol", "left_semi"),
    )
    assert [r["symbol"] for r in moved.collect()] == ["AAA"]
    bars = local(store.read_panel(spark, root), "date")
    assert len(bars) == 20
    assert ((bars["adj_close"] / bars["close"] - 0.95).abs() < 1e-12).all()
    store.compact(spark, root, str(tmp_path / "compact"))
    assert store.read_panel(spark, str(tmp_path / "compact")).count() == 20


def test_coverage_and_missing_symbols(spark, tmp_path):
    root = str(tmp_path / "bars")
    store.write_batch(to_spark(spark, linear_bars(20)), root, 0)
    _, absent = store.load_many(spark, root, ["AAA", "ZZZ"])
    assert [r["symbol"] for r in absent.collect()] == ["ZZZ"]
    bars, lacking = store.load_range(spark, root, ["AAA", "ZZZ"], "2024-01-01", "2024-12-31")
    assert bars.count() == 20 and [r["symbol"] for r in lacking.collect()] == ["ZZZ"]
    with pytest.raises(ValueError):
        store.load_range(spark, root, ["AAA"], "2020-01-01", "2024-12-31")


def test_file_stream_is_idempotent(spark, tmp_path):
    landing, root, mark = (str(tmp_path / p) for p in ("landing", "bars", "mark"))
    to_spark(spark, linear_bars(20)).write.parquet(landing)
    for _ in range(2):
        ingest_bars(spark, landing, BARS, root, mark).awaitTermination()
    assert store.read_panel(spark, root).count() == 20
    to_spark(spark, linear_bars(25)).write.mode("append").parquet(landing)
    ingest_bars(spark, landing, BARS, root, mark).awaitTermination()
    assert store.read_panel(spark, root).count() == 25


def test_range_read_sees_a_reload_outside_the_range(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(20)
    store.write_batch(to_spark(spark, pdf), root, 0)
    store.write_batch(to_spark(spark, pdf.iloc[15:]), root, 1, store.RELOAD)
    first = str(pdf["date"].iloc[0])[:10]
    assert store.read_panel(spark, root, ["AAA"], end=first).isEmpty()
    with pytest.raises(ValueError, match="buckets"):
        store.write_batch(to_spark(spark, pdf), root, 2, buckets=8)


def test_restated_rows_wait_and_are_not_lost(spark, tmp_path):
    landing, root, mark = (str(tmp_path / p) for p in ("landing", "bars", "mark"))
    pdf = linear_bars(25)
    rebased = pdf.assign(adj_close=pdf["close"] * 0.95)
    parts = [pdf.iloc[:15], rebased.iloc[14:18], rebased.iloc[18:22]]
    for part in parts:
        to_spark(spark, part).write.mode("append").parquet(landing)
        ingest_bars(spark, landing, BARS, root, mark).awaitTermination()
    assert store.read_panel(spark, root).count() == 15
    history = to_spark(spark, rebased.iloc[:16])
    merge_increment(spark, to_spark(spark, rebased.iloc[22:]), root, 9,
                    lambda symbols: history.join(symbols, "symbol", "left_semi"))
    bars = local(store.read_panel(spark, root), "date")
    assert len(bars) == 25 and ((bars["adj_close"] / bars["close"] - 0.95).abs() < 1e-12).all()


def test_next_bar_is_linear_in_history(spark):
    n = 40_000
    bars = spark.range(n).selectExpr(
        "'A' AS symbol", "date_add(DATE '1900-01-01', CAST(id AS INT)) AS date", "1.0 + id AS close", "1.0 + id AS adj_close"
    )
    log = bars.selectExpr("symbol", "date AS bar_date")
    out = next_bars(log, bars)
    assert out.count() == n - 1
    assert out.where("target_date <> date_add(bar_date, 1)").isEmpty()


def test_bar_finality(spark):
    def final(day, now):
        d = F.lit(day).cast("date")
        return spark.range(1).select(bar_is_final(d, now)).first()[0]

    assert final("2026-01-05", "2026-01-06 01:00:00")  # still the 5th, 20:00 in New York
    assert not final("2026-01-05", "2026-01-05 19:00:00")
    assert final("2026-01-05", "2026-01-05 21:00:00")
    assert not final("2026-01-07", "2026-01-06 23:00:00")


def test_next_bar_skips_holidays(spark):
    bars = to_spark(spark, linear_bars(10, start="2026-01-05")).where("date <> DATE '2026-01-08'")
    log = spark.createDataFrame(
        [("AAA", dt.date(2026, 1, 7)), ("AAA", dt.date(2026, 1, 8)), ("AAA", dt.date(2026, 1, 16))],
        "symbol string, bar_date date",
    )
    got = {r["bar_date"].day: r["target_date"].day for r in next_bars(log, bars).collect()}
    assert got == {7: 9, 8: 9}


def test_daily_job_predicts_once_and_scores_later(spark, tmp_path):
    pdf = walk(300, start="2025-01-02")
    spec = StudySpec(model="linear")
    bars = to_spark(spark, pdf, seq=True)
    train = attach_target(build_features(bars.drop("ingest_seq")))
    folder = save_model(fit_model(train, FEATURES, "linear"), str(tmp_path / "model"))
    root = str(tmp_path / "log")
    day = [str(d) for d in pdf["date"]]
    part = bars.where(F.col("date") <= day[298])
    noon, late = f"{day[298]} 16:00:00", f"{day[298]} 23:00:00"

    short = bars.where(F.col("date") > day[260]).withColumn("symbol", F.lit("NEW"))

    def status(batch, rows, now):
        rows = rows.unionByName(short.where(F.col("date") <= day[298]))
        out = {r["symbol"]: r["status"] for r in run_daily(spark, rows, folder, root, batch, now, spec).collect()}
        assert out["NEW"] == "too_short"
        return out["AAA"]

    assert status(0, part, noon) == "bar_not_final"
    assert status(1, part, late) == "predicted"
    assert status(1, part, late) == "predicted"  # the same batch again
    assert status(2, part, late) == "no_new_bar"
    assert status(3, bars, f"{day[299]} 23:00:00") == "predicted"
    log = local(read_log(spark, root), "bar_date")
    assert len(log) == 2
    assert str(log["target_date"][0]) == day[299]
    want = pdf["close"].iloc[299] / pdf["close"].iloc[298] - 1
    assert abs(log["realised_return"][0] - want) < 1e-12
    card = scorecard(read_log(spark, root)).first()
    assert (card["n_predictions"], card["n_scored"]) == (2, 1)


def test_daily_run_reads_only_the_tail(spark):
    bars = to_spark(spark, walk(3000, start="2010-01-01"), seq=True)
    spec = StudySpec(model="linear")
    log = spark.createDataFrame([], LOG_SCHEMA)
    n = recent(bars, log, spec).count()
    assert n == 2 * (400 + look_back(spec.features)) < 3000
    first = bars.orderBy("date").first()["date"]
    asked = spark.createDataFrame([(first + dt.timedelta(days=90), "AAA", None)], "bar_date date, symbol string, realised_return double")
    assert recent(bars, asked, spec).count() > n


def test_daily_run_reads_on_where_cleaning_drops_most(spark):
    pdf = walk(2400, start="2010-01-01")
    # of the last 1,300 dates only every twentieth has a price at all
    bad = (pdf.index >= 1100) & (pdf.index % 20 != 0)
    pdf.loc[bad, ["open", "high", "low", "close", "adj_close"]] = float("nan")
    whole = walk(2400, seed=3, symbol="BBB", start="2010-01-01")
    raw = to_spark(spark, pdf, seq=True).unionByName(to_spark(spark, whole, seq=True))
    spec = StudySpec(model="linear")
    got = recent_bars(raw, spark.createDataFrame([], LOG_SCHEMA), spec)
    n = {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()}
    want = clean(raw)
    assert n["AAA"] == want.where("symbol = 'AAA'").count() and n["AAA"] > 1000
    assert n["BBB"] == 2 * (400 + look_back(spec.features))
    tail = latest_features(got, spec).where("symbol = 'AAA'").first()
    full = latest_features(want, spec).where("symbol = 'AAA'").first()
    assert tail["date"] == full["date"] and abs(tail["ret_1d"] - full["ret_1d"]) < 1e-12


def test_log_text_is_coerced(spark):
    df = spark.createDataFrame([("2026-01-05", "", "nan", "0.5x")], "bar_date string, target_date string, correct string, prediction string")
    row = coerce_log(df).first()
    assert row["bar_date"] == dt.date(2026, 1, 5)
    assert row["target_date"] is None and row["correct"] is None and row["prediction"] is None
