import datetime as dt

import pytest

from barloom.sources.ticks import bars_from_ticks
from barloom.streaming.ingest import stream_bars

SCHEMA = "symbol string, ts timestamp, seq bigint, price double, volume double"


def test_closed_bars_leave_the_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 2, 10)
    ticks = [("A", day + dt.timedelta(hours=i), i, p, 2.0) for i, p in enumerate([5.0, 9.0, 4.0, 6.0])]
    ticks.append(("A", day + dt.timedelta(days=5), 9, 7.0, 1.0))
    spark.createDataFrame(ticks, SCHEMA).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "ticks"))
    query = (
        stream_bars(stream, "day", "1 hour")
        .writeStream.format("memory")
        .queryName("closed_bars")
        .outputMode("append")
        .trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "mark"))
        .start()
    )
    query.awaitTermination()
    rows = spark.table("closed_bars").collect()
    assert len(rows) == 1
    bar = rows[0]
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (5, 9, 4, 6, 8)
    assert bar["date"] == dt.date(2024, 1, 2)


@pytest.mark.parametrize("every", ["hour", "day", "week"])
def test_stream_and_batch_bars_agree(spark, every):
    day = dt.datetime(2024, 1, 5, 10)
    ticks = spark.createDataFrame(
        [("A", day + dt.timedelta(hours=7 * i), i, 0.1 * (-1) ** i * i, 2.0) for i in range(40)], SCHEMA
    )
    a, b = stream_bars(ticks, every, "1 hour"), bars_from_ticks(ticks, every)
    assert a.dtypes == b.dtypes
    assert sorted(a.collect()) == sorted(b.collect())
