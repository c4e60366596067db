from pyspark.sql import functions as F

from barloom.functions.durable import checkpointed
from barloom.operators.features import build_features, feature_matrix
from barloom.streaming.state import advance, feature_state
from tests.frames import local, to_spark, walk


def whole(bars):
    return local(feature_matrix(build_features(bars)), "symbol", "date")


def close_to(got, want):
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert (got[["symbol", "date"]] == want[["symbol", "date"]]).all().all()
    numbers = want.columns[2:]
    scale = want[numbers].abs().clip(lower=1.0)
    assert ((got[numbers] - want[numbers]).abs() / scale < 1e-9).all().all()


def test_a_day_at_a_time_equals_the_whole_history(spark):
    long, short, new = walk(700, 3, "LONG"), walk(230, 4, "SHORT", "2022-11-15"), walk(40, 5, "NEW", "2023-08-01")
    long["adj_close"] = long["close"] * 0.9
    bars = to_spark(spark, long).unionByName(to_spark(spark, short)).unionByName(to_spark(spark, new))
    days = sorted({str(d) for d in long["date"]})[-4:]
    state = checkpointed(feature_state(bars.where(F.col("date") < days[0])))
    assert state.groupBy("symbol").count().agg(F.max("count")).first()[0] == 253
    out = None
    for day in days:
        rows, after = advance(state, bars.where(F.col("date") == day))
        rows, state = checkpointed(rows), checkpointed(after)
        out = rows if out is None else out.unionByName(rows)
    want = whole(bars)
    want = want[want["date"].astype(str).isin(days)].reset_index(drop=True)
    close_to(local(out, "symbol", "date"), want)
    seen = {r["symbol"]: r["max(seen)"] for r in state.groupBy("symbol").agg({"seen": "max"}).collect()}
    assert seen["LONG"] == 700 and seen["SHORT"] == bars.where(f"symbol = 'SHORT' AND date <= '{days[-1]}'").count()


def test_batches_growing_symbols_and_overlap(spark):
    bars = to_spark(spark, walk(420, 8, "AAA")).unionByName(to_spark(spark, walk(300, 9, "BBB")))
    dates = sorted({str(r["date"]) for r in bars.select("date").distinct().collect()})
    state = checkpointed(feature_state(bars.where(F.col("date") < dates[180])))
    out = None
    for lo, hi in ((180, 270), (260, 330), (330, 420)):
        # the second batch overlaps with bars already seen
        rows, after = advance(state, bars.where((F.col("date") >= dates[lo]) & (F.col("date") <= dates[hi - 1])))
        rows, state = checkpointed(rows), checkpointed(after)
        out = rows if out is None else out.unionByName(rows)
    want = whole(bars)
    close_to(local(out, "symbol", "date"), want[want["date"].astype(str) >= dates[180]].reset_index(drop=True))


def test_empty_state_and_empty_batch(spark):
    bars = to_spark(spark, walk(300, 2))
    state = feature_state(bars)
    rows, after = advance(state, bars.limit(0))
    assert rows.count() == 0 and after.count() == state.count() == 253
    rows, _ = advance(state.limit(0), bars)
    close_to(local(rows, "symbol", "date"), whole(bars))
