"""Shards from fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import shared_folder, stored

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096

#: Parts into which the rows of one slot are ordered, so a repeated key is not one task.
PARTS = 8


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of each slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]


def first_map(slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, 1, (0,) * slots)


def add_shard(m: SlotMap) -> SlotMap:
    """The map with one more shard; slots move only into the new shard.

    Every shard gives up each (n + 1)-th of its slots, so that all shards hold
    about the same number again.  The edit depends on the map alone.
    """
    new, seen, out = m.shards, [0] * m.shards, list(m.shard_of)
    for slot, shard in enumerate(m.shard_of):
        if seen[shard] % (new + 1) == new:
            out[slot] = new
        seen[shard] += 1
    return SlotMap(m.version + 1, new + 1, tuple(out))


def map_for(shards: int, slots: int = SLOTS) -> SlotMap:
    """The map that growth from one shard leads to; the shard count decides it."""
    m = first_map(slots)
    while m.shards < shards:
        m = add_shard(m)
    return m


def rebalance(m: SlotMap, bytes_of: dict[int, int], version: int | None = None) -> SlotMap:
    """Move slots from the heaviest to the lightest shard while that evens out bytes.

    ``bytes_of`` has the bytes of each slot; the table is bounded by the slots.
    ``version`` names the edit where other edits of the same map exist.
    """
    out = list(m.shard_of)
    load = [0] * m.shards
    for slot, shard in enumerate(out):
        load[shard] += bytes_of.get(slot, 0)
    for _ in range(len(out)):
        heavy, light = load.index(max(load)), load.index(min(load))
        gap = load[heavy] - load[light]
        fitting = [s for s, shard in enumerate(out) if shard == heavy and 0 < bytes_of.get(s, 0) < gap]
        if not fitting:
            break
        best = min(fitting, key=lambda s: (abs(gap - 2 * bytes_of[s]), s))
        out[best] = light
        load[heavy] -= bytes_of[best]
        load[light] += bytes_of[best]
    return SlotMap(version or m.version + 1, m.shards, tuple(out))


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    return spark.createDataFrame(
        [(m.version, m.shards, s, x) for s, x in enumerate(m.shard_of)],
        "version int, shards int, virtual_slot int, shard int",
    )


def save_map(spark: SparkSession, m: SlotMap, root: str) -> None:
    """Write one version below ``root``; other versions stay."""
    map_table(spark, m).coalesce(1).write.mode("overwrite").parquet(f"{root}/version={m.version}")


def load_map(spark: SparkSession, root: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{root}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def virtual_slot(key: Sequence[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def bytes_per_slot(records: DataFrame) -> DataFrame:
    """Bytes and rows per ``(virtual_slot, part)``: bounded, combined before the shuffle."""
    return records.groupBy("virtual_slot", "part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")
    )


def shard_panel(
    bars: DataFrame,
    size: Column,
    shards: int = 8,
    key: Sequence[str] = ("symbol", "date"),
    slots: int = SLOTS,
    carry: dict[str, Column] | None = None,
    map_root: str | None = None,
) -> DataFrame:
    """Put bars (any keyed records) into shards by key and shard count alone.

    A key hashes to one of ``slots`` virtual slots and the stored map of that
    shard count names the slot's shard; ``grown_shard`` is the shard under the
    next version, with one shard more, and ``even_shard`` the one under an edit
    of the map by the bytes of the slots, which law ``key`` does not follow but
    an owner of the data may.  All versions are written below ``map_root`` (a
    folder of the session by default) and rows are placed by what is read back.
    Returns the key columns, ``size``, the ``carry`` columns, ``virtual_slot``,
    ``shard``, ``grown_shard``, ``even_shard``, ``slot_bytes`` (all bytes of the
    virtual slot) and ``slot``: the row's place in its shard, gapless from 0.

    A null in the key is a key value of its own.  Rows with equal keys share a
    shard and take places in order of content; fully repeated rows take
    consecutive places.  An empty table gives an empty result.
    """
    spark = bars.sparkSession
    carry = carry or {}
    map_root = map_root or shared_folder(spark, "slot-maps")
    slim = stored(
        bars.select(
            *key,
            size.cast("bigint").alias("size"),
            *[c.alias(n) for n, c in carry.items()],
            virtual_slot(key, slots).alias("virtual_slot"),
        )
        .withColumn("__mark", F.xxhash64(*key, "size", *carry))
        .withColumn("part", F.pmod("__mark", F.lit(PARTS)).cast("int"))
    )
    filled = stored(bytes_per_slot(slim))
    # one row per virtual slot
    bytes_of = {r["virtual_slot"]: r["b"] for r in filled.groupBy("virtual_slot").agg(F.sum("bytes").alias("b")).collect()}
    now = map_for(shards, slots)
    then = add_shard(now)
    even = rebalance(now, bytes_of, then.version + 1)
    named = None
    for m, column in ((now, "shard"), (then, "grown_shard"), (even, "even_shard")):
        save_map(spark, m, map_root)
        read = map_table(spark, load_map(spark, map_root, m.version)).select("virtual_slot", F.col("shard").alias(column))
        named = read if named is None else named.join(read, "virtual_slot")
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most slots x PARTS rows, whatever the data: small enough to window and to broadcast.
    places = (
        filled.join(named, "virtual_slot")
        .withColumn("__before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("slot_bytes", F.sum("bytes").over(Window.partitionBy("virtual_slot")))
        .drop("bytes", "n")
    )
    inside = Window.partitionBy("virtual_slot", "part").orderBy(*key, "__mark")
    return (
        slim.withColumn("__at", F.row_number().over(inside))
        .join(F.broadcast(places), ["virtual_slot", "part"])
        .select(
            *key, "size", *carry, "virtual_slot", "shard", "grown_shard", "even_shard", "slot_bytes",
            (F.col("__before") + F.col("__at") - 1).alias("slot"),
        )
    )
