import zlib

from pyspark.sql import functions as F

from barloom.llm import sharding
from barloom.llm.queries import op1_sharding


def check(rows, shards):
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    for r in rows:
        assert 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_sharding(spark, sf).collect()
    check(rows, 8)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    assert {r.shard for r in rows} == set(range(8)) and any(r.grown_shard == 8 for r in rows)


def test_key_and_shard_count_decide(spark):
    bars = spark.createDataFrame(
        [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("B", "2024-01-01", 3.0), (None, "2024-01-01", 4.0)],
        "symbol string, date string, close double",
    )
    place = {(r.symbol, r.date): r.shard for r in sharding.shard_panel(bars, F.lit(48), 5).collect()}
    some = sharding.shard_panel(bars.where("close > 1").withColumn("shard", F.lit(9)), F.lit(99), 5)
    assert all(place[r.symbol, r.date] == r.shard for r in some.collect()) and some.count() == 3
    # growth is the next map
    grown = {(r.symbol, r.date): r.grown_shard for r in sharding.shard_panel(bars, F.lit(1), 5).collect()}
    assert grown == {(r.symbol, r.date): r.shard for r in sharding.shard_panel(bars, F.lit(1), 6).collect()}


def test_hot_key_and_empty(spark):
    bars = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("symbol"),
        F.lit("2024-01-01").alias("date"), (F.col("id") % 7).alias("close"),
    )
    rows = sharding.shard_panel(bars, F.col("close") + 1, 4).collect()
    assert len(rows) == 900
    check(rows, 4)
    assert sharding.shard_panel(bars.limit(0), F.lit(1), 4).count() == 0


def test_bytes_of_slots_edit_the_stored_map(spark, tmp_path):
    bars = spark.range(3000).select(
        F.concat(F.lit("S"), F.col("id") % 500).alias("symbol"), F.col("id").alias("date"),
        F.when(F.col("id") % 500 < 5, 5000).otherwise(10).alias("close"),
    )
    rows = sharding.shard_panel(bars, F.col("close"), 4, key=("symbol",), slots=256, map_root=str(tmp_path)).collect()
    load = {}
    for r in rows:
        for column in ("shard", "even_shard"):
            load[column, r[column]] = load.get((column, r[column]), 0) + r["size"]
    spread = {c: max(v for (k, _), v in load.items() if k == c) - min(v for (k, _), v in load.items() if k == c) for c in ("shard", "even_shard")}
    assert spread["even_shard"] < spread["shard"]
    # what placed the rows is what is stored
    versions = {c: sharding.load_map(spark, str(tmp_path), v) for c, v in (("shard", 4), ("grown_shard", 5), ("even_shard", 6))}
    assert all(versions[c].shard_of[r["virtual_slot"]] == r[c] for r in rows for c in versions)


def test_maps(spark, tmp_path):
    m = sharding.map_for(8)
    counts = [m.shard_of.count(s) for s in range(8)]
    assert max(counts) - min(counts) <= 8 and m.version == 8
    more = sharding.add_shard(m)
    assert all(a == b or b == 8 for a, b in zip(m.shard_of, more.shard_of)) and more.version == 9
    small = sharding.map_for(3, slots=12)
    heavy = sharding.rebalance(small, {s: 100 if small.shard_of[s] == 0 else 1 for s in range(12)})
    load = [sum(100 if small.shard_of[s] == 0 else 1 for s in range(12) if heavy.shard_of[s] == k) for k in range(3)]
    assert max(load) - min(load) <= 101 and heavy.version == small.version + 1
    sharding.save_map(spark, small, str(tmp_path))
    sharding.save_map(spark, heavy, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), small.version) == small
    assert sharding.load_map(spark, str(tmp_path), heavy.version) == heavy
