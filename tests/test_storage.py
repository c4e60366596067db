from barloom.functions.durable import bucketed
from barloom.operators.features import build_features, feature_matrix
from barloom.sources.ticks import bars_from_ticks, trade_ticks
from tests.frames import local, to_spark, walk

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hash"), plan


def test_windows_over_a_stored_panel_need_no_exchange(spark):
    bars = to_spark(spark, walk(300)).unionByName(to_spark(spark, walk(280, 2, "BBB")))
    stored = bucketed(bars, "symbol", 4)
    built = feature_matrix(build_features(stored))
    assert exchanges(built)[0] == 0
    assert exchanges(feature_matrix(build_features(bars)))[0] == 1
    a, b = (local(feature_matrix(build_features(x)), "symbol", "date") for x in (stored, bars))
    assert len(a) == len(b) and (a["rsi_14"] - b["rsi_14"]).abs().max() < 1e-12


def test_ticks_and_parts_meet_in_their_buckets(spark):
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = trade_ticks(lines, parts, "p_brand")
        stored = trade_ticks(bucketed(lines, "l_partkey", 4), bucketed(parts, "p_partkey", 4), "p_brand")
        assert exchanges(plain)[0] == 2 and exchanges(stored)[0] == 0
        want, got = (local(bars_from_ticks(x), "symbol", "date") for x in (plain, stored))
        assert want.equals(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
