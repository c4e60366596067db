import pytest
from pyspark.sql import functions as F

from barloom.plans import catalog, inputs
from barloom.sources import panel_store as store
from barloom.streaming.ingest import merge_increment
from tests.frames import linear_bars, local, to_spark, walk


def days(df):
    return [str(r["date"])[8:] for r in df.orderBy("date").collect()]


def test_compaction_keeps_rows_that_wait(spark, tmp_path):
    pdf = linear_bars(5)
    moved = pdf.assign(adj_close=pdf["close"] * 0.95)
    roots = [str(tmp_path / x) for x in ("plain", "folded")]
    for root in roots:
        store.write_batch(to_spark(spark, pdf.iloc[:2]), root, 0)
        merge_increment(spark, to_spark(spark, moved.iloc[1:3]), root, 1)
    target = str(tmp_path / "target")
    store.compact(spark, roots[1], target)
    history = to_spark(spark, moved.iloc[[0, 1, 3]])
    panels = []
    for root in (roots[0], target):
        merge_increment(spark, to_spark(spark, moved.iloc[4:]), root, 2, lambda s: history.join(s, "symbol", "left_semi"))
        panels.append(local(store.read_panel(spark, root), "date"))
    assert len(panels[0]) == 5 and panels[0].equals(panels[1])


def test_tiers_merge_and_old_versions_stay_readable(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(40)
    store.write_batch(to_spark(spark, pdf.iloc[:20]), root, 0)
    for k in range(1, 7):
        part = pdf.iloc[17 + 2 * k : 20 + 2 * k].assign(volume=1e6 + k)
        store.write_batch(to_spark(spark, part), root, k, store.RELOAD if k == 3 else store.MERGE)
    before, version = local(store.read_panel(spark, root), "date"), store.versions(spark, root)[-1]
    reader = store.read_panel(spark, root)
    parts = store.merge_tiers(spark, root)
    assert len(parts) == 3 and parts[-1] == store.Part(0, 6) and parts[1].run > 0
    assert local(store.read_panel(spark, root), "date").equals(before)
    assert local(reader, "date").equals(before)
    assert local(store.read_panel(spark, root, version=version), "date").equals(before)
    assert store.last_reloads(store.zones(spark, root)).first()["__since"] == 3
    with pytest.raises(ValueError, match="merged"):
        store.write_batch(to_spark(spark, pdf), root, 4)
    gone = store.vacuum(spark, root, keep=1)
    assert store.Part(0, 2) in gone and local(store.read_panel(spark, root), "date").equals(before)


def test_range_reads_open_overlapping_files_only(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(60)
    for k in range(4):
        store.write_batch(to_spark(spark, pdf.iloc[15 * k : 15 * k + 15]), root, k)
    store.write_batch(to_spark(spark, walk(30, symbol="BBB", start="2024-01-01")), root, 4)
    lo, hi = str(pdf["date"].iloc[20]), str(pdf["date"].iloc[25])
    part = store.read_panel(spark, root, ["aaa"], lo, hi)
    assert part.count() == 6
    bars = {f.split("batch=")[1].split("/")[0] for f in part.inputFiles() if "_manifest" not in f}
    assert bars == {"1"}


def test_edges_and_restatements_read_zone_maps(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = walk(60, symbol="AAA")
    store.write_batch(to_spark(spark, pdf.iloc[:50]), root, 0)
    revised = pdf.iloc[45:50].assign(adj_close=pdf["close"].iloc[45:50] * 0.9)
    store.write_batch(to_spark(spark, revised), root, 1)
    store.write_batch(to_spark(spark, walk(30, symbol="BBB")), root, 2)
    panel = store.read_panel(spark, root)
    assert sorted(map(tuple, store.stored_latest(spark, root).collect())) == sorted(map(tuple, store.latest_bar(panel).collect()))
    for fresh in (
        pdf.iloc[48:55], pdf.iloc[48:55].assign(adj_close=pdf["close"] * 0.9), pdf.iloc[40:47], pdf.iloc[55:], pdf.iloc[:3],
    ):
        new = to_spark(spark, fresh)
        want, got = (sorted(map(tuple, x.collect())) for x in (store.restatements(panel, new), store.stored_restatements(spark, root, new)))
        assert got == want
    decided = store.stored_restatements(spark, root, to_spark(spark, pdf.iloc[48:55]))
    assert all("_manifest" in f for f in decided.inputFiles() if root in f)


@pytest.mark.parametrize("start", ["2020-12-20", "2020-12-24", "2021-01-04", "2021-02-20", "2021-03-27", "2022-01-01"])
def test_coverage_equals_the_scan(spark, tmp_path, start):
    root = str(tmp_path / "bars")
    pdf = walk(60)
    gap = pdf[(pdf["date"] < pdf["date"].iloc[30]) | (pdf["date"] > pdf["date"].iloc[40])]
    store.write_batch(to_spark(spark, gap), root, 0)
    store.write_batch(to_spark(spark, walk(60, symbol="BBB")), root, 1)
    store.write_batch(to_spark(spark, walk(20, symbol="BBB", start="2021-02-22")), root, 2, store.RELOAD)
    panel = store.read_panel(spark, root)
    want = store.history_coverage(panel, start, "2030-01-01").select("symbol", "covers_start")
    got = store.stored_coverage(spark, root, start)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_store_and_empty_batch(spark, tmp_path):
    root = str(tmp_path / "bars")
    assert store.read_panel(spark, root).isEmpty() and store.stored_latest(spark, root).isEmpty()
    store.write_batch(to_spark(spark, linear_bars(3)).limit(0), root, 0)
    assert store.read_panel(spark, root, ["AAA"], "2024-01-01").isEmpty()
    store.write_batch(to_spark(spark, linear_bars(3)), root, 1)
    assert store.read_panel(spark, root).count() == 3 and store.merge_tiers(spark, root) == [store.Part(0, 0), store.Part(0, 1)]
    assert store.read_panel(spark, root).where(F.col("symbol") == "AAA").count() == 3


def counted(spark, rows):
    """The rows, and how many of them Spark has computed."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(through, rows.schema), seen


def test_increment_is_computed_once(spark, tmp_path):
    root = str(tmp_path / "bars")
    pdf = linear_bars(5)
    moved = pdf.assign(adj_close=pdf["close"] * 0.95)
    store.write_batch(to_spark(spark, pdf.iloc[:2]), root, 0)
    history = to_spark(spark, moved.iloc[:2])
    for batch, part, source in ((1, moved.iloc[1:3], None), (2, moved.iloc[3:], lambda s: history.join(s, "symbol", "left_semi"))):
        fresh, seen = counted(spark, to_spark(spark, part))
        merge_increment(spark, fresh, root, batch, source)
        assert seen.value == 2
    assert store.read_panel(spark, root).count() == 5


@pytest.mark.parametrize("name", ["held_back_increment", "store_compacted", "incremental_store"])
def test_store_queries_compute_their_bars_once(spark, monkeypatch, name):
    rows = spark.sql(
        "SELECT symbol, date, 1D AS open, 2D AS high, 1D AS low, 1D AS close, 1D AS adj_close, 5D AS volume "
        "FROM (SELECT explode(sequence(DATE '1999-11-01', DATE '2001-08-01', INTERVAL 10 DAYS)) AS date) "
        "CROSS JOIN VALUES ('A'), ('N') AS s (symbol)"
    )
    bars, seen = counted(spark, rows)
    monkeypatch.setattr(inputs, "trade_bars", lambda *_: bars)
    assert catalog.QUERIES[name](spark, "").count() == seen.value == rows.count()
