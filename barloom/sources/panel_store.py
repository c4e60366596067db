"""The bar store: append-only increments, an index, published versions, newest revision wins on read.

Plain Parquet has no merge, and rewriting a 100 TB panel for a day of new bars
is out of the question.  Every increment is therefore its own directory,
``run=0/batch=<id>/bucket=<b>``, written with overwrite: repeating a batch after
a failure replaces it and nothing else.  A read keeps, per (symbol, date), the
row of the highest batch, and forgets everything before the latest full reload
of a symbol.

``_manifest`` has zone maps: one row per increment, bucket and symbol with the
first and last date and the adjustment basis there, the rows, and the batch of
a reload.  Look-ups of latest bars, coverage, reloads and restatements read it
instead of bars, and a range read opens only directories that overlap.

``_versions/<n>`` lists the increments that make up version n and is written
last; readers take the newest complete one and keep to it.  ``merge_tiers``
replaces neighbouring increments of one size class by their merge, under a new
``run``, so an old reader still finds what its version lists until ``vacuum``.
``compact`` folds everything into a fresh store.

``bucket`` is a checksum of the symbol, so asking for some symbols prunes
directories, and dates prune row groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.cleaning import FIELDS
from barloom.sources.raw_bars import LoadError

BUCKETS = 64
OVERLAP_DAYS = 7
SLACK_DAYS = 10
MERGE, RELOAD = "merge", "reload"

#: Neighbouring increments of one size class that become one, and the ratio of size classes.
TIER = 4

STORE_SCHEMA = (
    "symbol string, date date, open double, high double, low double, close double, "
    "adj_close double, volume double, reloaded bigint, run bigint, batch bigint, bucket int"
)
ZONE_SCHEMA = (
    "symbol string, first_date date, last_date date, first_basis double, last_basis double, n_rows bigint, "
    "reloaded bigint, bucket int, run bigint, batch bigint"
)


class Part(NamedTuple):
    """An increment (run 0) or the merge of several, named by the last."""

    run: int
    batch: int

    def folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/run={self.run}/batch={self.batch}"


def bucket_of(symbol: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(symbol.cast("binary")) % buckets).cast("int")


def bucket_number(symbol: str, buckets: int = BUCKETS) -> int:
    """The same number on the driver, for directory pruning."""
    return zlib.crc32(symbol.encode()) % buckets


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a store, ascending."""
    folder = f"{root.rstrip('/')}/_versions"
    if not _exists(spark, folder):
        return []
    fs, p = _fs(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and _exists(spark, f"{folder}/{n}/_SUCCESS"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> list[Part]:
    """The parts of a version (default: the newest), by batch; none where nothing is stored."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return []
        version = known[-1]
    lines = spark.read.text(f"{root.rstrip('/')}/_versions/{version}").collect()
    return sorted((Part(*map(int, r[0].split())) for r in lines), key=lambda p: p.batch)


def _publish(spark: SparkSession, root: str, parts: Sequence[Part]) -> None:
    number = (versions(spark, root) or [0])[-1] + 1
    lines = spark.createDataFrame([(f"{p.run} {p.batch}",) for p in parts], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/_versions/{number}")


def _write_part(bars: DataFrame, root: str, part: Part, buckets: int) -> None:
    """Write bars ``(symbol, date, fields, reloaded)`` and their zone maps.

    Rows go to their bucket by date range as well, so a symbol that makes up
    most of an increment is written by several tasks.
    """
    spark = bars.sparkSession
    (
        bars.select("symbol", "date", *FIELDS, "reloaded")
        .withColumn("bucket", bucket_of(F.col("symbol"), buckets))
        .repartitionByRange("bucket", "symbol", "date")
        .sortWithinPartitions("bucket", "symbol", "date")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(part.folder(root))
    )
    basis = ratio("adj_close", "close")
    zones = read_parts(spark, root, [part]).groupBy("symbol", "bucket").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by(basis, "date").alias("first_basis"), F.max_by(basis, "date").alias("last_basis"),
        F.count("date").alias("n_rows"), F.max("reloaded").alias("reloaded"),
    )
    zones.write.mode("overwrite").parquet(part.folder(f"{root}/_manifest"))


def write_batch(
    bars: DataFrame, root: str, batch: int, kind: str = MERGE, buckets: int = BUCKETS
) -> None:
    """Store one increment and publish it.  ``kind`` may also be a column of ``bars``.

    The first batch fixes the number of buckets; another number is an error, and
    so is a batch that has been merged with others already.
    """
    spark, root = bars.sparkSession, root.rstrip("/")
    known = stored_buckets(spark, root)
    if known is None:
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{root}/_buckets"
        )
    elif known != buckets:
        raise ValueError(f"the store at {root} has {known} buckets, not {buckets}")
    parts = snapshot(spark, root)
    if any(p.run and p.batch >= batch for p in parts):
        raise ValueError(f"batch {batch} of {root} has been merged; it cannot be written again")
    if "kind" not in bars.columns:
        bars = bars.withColumn("kind", F.lit(kind))
    bars = bars.withColumn("reloaded", F.when(F.col("kind") == RELOAD, F.lit(batch)).cast("bigint"))
    _write_part(bars, root, Part(0, batch), buckets)
    if Part(0, batch) not in parts:
        _publish(spark, root, [*parts, Part(0, batch)])


def read_parts(spark: SparkSession, root: str, parts: Sequence[Part], folders: Sequence[str] | None = None) -> DataFrame:
    """Every stored revision of some parts, or of some of their directories."""
    root = root.rstrip("/")
    paths = [p.folder(root) for p in parts] if folders is None else list(folders)
    if not paths:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).option("basePath", root).parquet(*paths)


def read_increments(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Every stored revision of the newest version; empty when nothing has been stored."""
    return read_parts(spark, root, _before(snapshot(spark, root), before))


def _before(parts: Sequence[Part], before: int | None) -> list[Part]:
    return [p for p in parts if before is None or p.batch < before]


def zones(spark: SparkSession, root: str, parts: Sequence[Part] | None = None) -> DataFrame:
    """The zone maps of some parts (default: of the newest version): no bar is read."""
    parts = snapshot(spark, root) if parts is None else parts
    if not parts:
        return spark.createDataFrame([], ZONE_SCHEMA)
    base = f"{root.rstrip('/')}/_manifest"
    return spark.read.schema(ZONE_SCHEMA).option("basePath", base).parquet(*[p.folder(base) for p in parts])


def last_reloads(increments: DataFrame) -> DataFrame:
    """The batch of each symbol's last full reload, from increments or their zones."""
    return (
        increments.where(F.col("reloaded").isNotNull()).groupBy("symbol").agg(F.max("reloaded").alias("__since"))
    )


def _live(rows: DataFrame, reloads: DataFrame) -> DataFrame:
    """What the last reload of its symbol has not made stale."""
    return rows.join(reloads, "symbol", "left").where(
        F.col("batch") >= F.coalesce("__since", F.lit(-(2**62)).cast("bigint"))
    )


def newest_revisions(increments: DataFrame, reloads: DataFrame | None = None) -> DataFrame:
    """The current panel: the newest revision per (symbol, date).

    ``reloads`` must come from all increments of the symbols; where the rows are
    cut to a date range, a reload outside it still makes older rows stale.  A
    reload without bars is one row without a date.  Both aggregates combine
    before the shuffle.
    """
    reloads = last_reloads(increments) if reloads is None else reloads
    live = _live(increments, reloads).where(F.col("date").isNotNull())
    return live.groupBy("symbol", "date").agg(
        *[F.max_by(c, "batch").alias(c) for c in FIELDS]
    )


def stored_buckets(spark: SparkSession, root: str) -> int | None:
    """The number of buckets a store was written with; None for a new one."""
    path = f"{root.rstrip('/')}/_buckets"
    return int(spark.read.text(path).first()[0]) if _exists(spark, path) else None


def read_panel(
    spark: SparkSession,
    root: str,
    symbols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """Current bars of the named symbols within [start, end], of a version of the store.

    The zone maps name the directories that can hold such bars, and reloads
    outside the range; only these directories are opened.
    """
    root, parts = root.rstrip("/"), snapshot(spark, root, version)
    zone = zones(spark, root, parts)
    wanted = None
    if symbols is not None:
        wanted = [s.upper() for s in symbols]
        buckets = stored_buckets(spark, root) or BUCKETS
        zone = zone.where(
            F.col("bucket").isin(sorted({bucket_number(s, buckets) for s in wanted})) & F.col("symbol").isin(wanted)
        )
    reloads = last_reloads(zone)
    if wanted is None and not start and not end:
        return newest_revisions(read_parts(spark, root, parts), reloads)
    inside = F.lit(True)
    if start:
        inside &= F.col("last_date") >= F.lit(start).cast("date")
    if end:
        inside &= F.col("first_date") <= F.lit(end).cast("date")
    # one row per directory of the store
    found = _live(zone, reloads).where(inside).select("run", "batch", "bucket").distinct().collect()
    folders = [f"{Part(r['run'], r['batch']).folder(root)}/bucket={r['bucket']}" for r in sorted(found)]
    rows = read_parts(spark, root, parts, folders)
    if wanted is not None:
        rows = rows.where(F.col("symbol").isin(wanted))
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return newest_revisions(rows, reloads)


def stored_edges(spark: SparkSession, root: str, parts: Sequence[Part] | None = None) -> DataFrame:
    """Per stored symbol: first and latest date and the adjustment basis there, from the zone maps alone."""
    zone = zones(spark, root, parts)
    live = _live(zone, last_reloads(zone)).where(F.col("n_rows") > 0)
    return live.groupBy("symbol").agg(
        F.min("first_date").alias("first"), F.max("last_date").alias("latest"),
        # of two revisions of the same day the later batch counts
        F.min_by("first_basis", F.struct("first_date", -F.col("batch"))).alias("first_basis"),
        F.max_by("last_basis", F.struct("last_date", "batch")).alias("last_basis"),
    )


def stored_latest(spark: SparkSession, root: str) -> DataFrame:
    """``latest_bar`` of a store, from the zone maps alone."""
    return stored_edges(spark, root).select("symbol", "latest")


def stored_coverage(spark: SparkSession, root: str, start: str) -> DataFrame:
    """Per stored symbol, ``covers_start``: does it have a bar in the first ``SLACK_DAYS`` days from start?

    A zone that begins or ends in these days says yes, one that lies outside
    says nothing; only for symbols whose zones all reach over them the bars of
    these days are read.
    """
    lo, hi = F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), SLACK_DAYS)
    parts = snapshot(spark, root)
    zone = zones(spark, root, parts)
    live = _live(zone, last_reloads(zone)).where(F.col("n_rows") > 0)
    edge = F.col("first_date").between(lo, hi) | F.col("last_date").between(lo, hi)
    over = (F.col("first_date") < lo) & (F.col("last_date") > hi)
    told = live.groupBy("symbol").agg(F.max(edge).alias("yes"), F.max(over).alias("maybe"))
    open_ = live.where(over).join(told.where("NOT yes AND maybe").select("symbol"), "symbol", "left_semi")
    found = open_.select("run", "batch", "bucket").distinct().collect()
    folders = [f"{Part(r['run'], r['batch']).folder(root)}/bucket={r['bucket']}" for r in sorted(found)]
    rows = _live(read_parts(spark, root, parts, folders).where(F.col("date").between(lo, hi)), last_reloads(zone))
    seen = rows.select("symbol").distinct().withColumn("seen", F.lit(True))
    return told.join(seen, "symbol", "left").select(
        "symbol", (F.col("yes") | F.coalesce("seen", F.lit(False))).alias("covers_start")
    )


def load_many(
    spark: SparkSession, root: str, symbols: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """The basket that is there, and the symbols that are not."""
    bars = read_panel(spark, root, symbols, **options)
    asked = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string").distinct()
    absent = asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")
    if bars.isEmpty():
        raise LoadError(f"none of {list(symbols)} is stored")
    return bars, absent


def latest_bar(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("latest"))


def history_coverage(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Whether the stored history really reaches back to a requested start."""
    lo, hi = (F.lit(d).cast("date") for d in (start, end))
    inside = F.when((F.col("date") >= lo) & (F.col("date") <= hi), F.col("date"))
    return bars.groupBy("symbol").agg(
        F.min(inside).alias("first_in_range"),
        F.count(inside).alias("rows_in_range"),
        F.coalesce(F.min(inside) <= F.date_add(lo, SLACK_DAYS), F.lit(False)).alias("covers_start"),
    )


def uncovered(bars: DataFrame, symbols: DataFrame, start: str, end: str) -> DataFrame:
    """Asked symbols whose stored history does not reach back to the start."""
    covered = history_coverage(bars, start, end).where("covers_start").select("symbol")
    return symbols.join(covered, "symbol", "left_anti")


def load_range(
    spark: SparkSession, root: str, symbols: Sequence[str], start: str, end: str
) -> tuple[DataFrame, DataFrame]:
    """Bars in range of the symbols whose history covers the start, and the other symbols.

    It is an error when no symbol is covered.
    """
    bars = read_panel(spark, root, symbols, start, end)
    asked = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string").distinct()
    covered = stored_coverage(spark, root, start).where("covers_start").select("symbol")
    # a range that ends within the slack covers its start only by a bar inside it
    lacking = asked.join(covered, "symbol", "left_anti").union(
        asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")
    ).distinct()
    out = bars.join(lacking, "symbol", "left_anti")
    if out.isEmpty():
        raise LoadError(f"stored history of {list(symbols)} starts after {start}")
    return out, lacking


def restatements(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per symbol in both: was the adjustment basis of history moved?

    The basis is adj_close / close on the newest shared date, or on the first
    row of each side without one.  A moved basis means every stored row of the
    symbol is stale and the whole history has to be read again.
    """
    old = existing.select("symbol", "date", ratio("adj_close", "close").alias("old"))
    new = fresh.select("symbol", "date", ratio("adj_close", "close").alias("new"))
    shared = (
        old.join(new, ["symbol", "date"])
        .groupBy("symbol")
        .agg(
            F.max("date").alias("shared_date"),
            F.max_by("old", "date").alias("shared_old"),
            F.max_by("new", "date").alias("shared_new"),
        )
    )
    firsts = (
        old.groupBy("symbol").agg(F.min_by("old", "date").alias("first_old"))
        .join(new.groupBy("symbol").agg(F.min_by("new", "date").alias("first_new")), "symbol")
        .join(shared, "symbol", "left")
    )
    has = F.col("shared_date").isNotNull()
    a = F.when(has, F.col("shared_old")).otherwise(F.col("first_old"))
    b = F.when(has, F.col("shared_new")).otherwise(F.col("first_new"))
    return firsts.select(
        "symbol", "shared_date", a.alias("old_basis"), b.alias("new_basis")
    ).withColumn("restated", ~_close(F.col("old_basis"), F.col("new_basis")))


def stored_restatements(spark: SparkSession, root: str, fresh: DataFrame, before: int | None = None) -> DataFrame:
    """``restatements`` of a store against fresh bars, as far as possible from the zone maps.

    An increment that holds the latest stored day of its symbol, as a daily one
    with an overlap does, is decided by the stored basis of that day.  Bars are
    read for other symbols only, and only from the days their fresh rows span.
    """
    parts = _before(snapshot(spark, root), before)
    fresh = fresh.select("symbol", "date", ratio("adj_close", "close").alias("new"))
    edges = stored_edges(spark, root, parts)
    sides = fresh.join(edges, "symbol").groupBy("symbol").agg(
        F.first("latest").alias("latest"), F.first("last_basis", True).alias("last_basis"),
        F.first("first_basis", True).alias("first_old"), F.min_by("new", "date").alias("first_new"),
        F.max_by("new", F.when(F.col("date") == F.col("latest"), F.col("date"))).alias("latest_new"),
        F.max(F.col("date") == F.col("latest")).alias("told"), F.min("date").alias("lo"), F.max("date").alias("hi"),
    )
    open_ = sides.where("NOT told")
    span = open_.agg(F.min("lo"), F.max("hi")).first()
    shared = spark.createDataFrame([], "symbol string, shared_date date, shared_old double, shared_new double")
    if span[0] is not None:
        zone = zones(spark, root, parts)
        reloads = last_reloads(zone)
        near = _live(zone, reloads).where((F.col("last_date") >= span[0]) & (F.col("first_date") <= span[1]))
        found = near.join(open_, "symbol", "left_semi").select("run", "batch", "bucket").distinct().collect()
        folders = [f"{Part(r['run'], r['batch']).folder(root)}/bucket={r['bucket']}" for r in sorted(found)]
        rows = read_parts(spark, root, parts, folders).where(F.col("date").between(span[0], span[1]))
        old = newest_revisions(rows.join(open_.select("symbol"), "symbol", "left_semi"), reloads)
        shared = (
            old.select("symbol", "date", ratio("adj_close", "close").alias("old")).join(fresh, ["symbol", "date"])
            .groupBy("symbol").agg(
                F.max("date").alias("shared_date"), F.max_by("old", "date").alias("shared_old"),
                F.max_by("new", "date").alias("shared_new"),
            )
        )
    has = F.col("shared_date").isNotNull()

    def pick(at_latest: str, at_shared: str, at_first: str) -> Column:
        return F.when(F.col("told"), F.col(at_latest)).when(has, F.col(at_shared)).otherwise(F.col(at_first))

    return sides.join(shared, "symbol", "left").select(
        "symbol", F.when(F.col("told"), F.col("latest")).otherwise(F.col("shared_date")).alias("shared_date"),
        pick("last_basis", "shared_old", "first_old").alias("old_basis"),
        pick("latest_new", "shared_new", "first_new").alias("new_basis"),
    ).withColumn("restated", ~_close(F.col("old_basis"), F.col("new_basis")))


def _close(a: Column, b: Column) -> Column:
    """Relative 1e-6 with the customary absolute 1e-8; missing equals missing."""
    same = F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-6) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(same, F.lit(False)))


def merge_newest(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both sides, with the fresh row winning on a shared date."""
    tagged = existing.select("symbol", "date", *FIELDS, F.lit(0).alias("__v")).unionByName(
        fresh.select("symbol", "date", *FIELDS, F.lit(1).alias("__v"))
    )
    return tagged.groupBy("symbol", "date").agg(
        *[F.max_by(c, "__v").alias(c) for c in FIELDS]
    )


def overlap_start(existing: DataFrame, days: int = OVERLAP_DAYS) -> DataFrame:
    """From which date each symbol should be read again."""
    return existing.groupBy("symbol").agg(F.date_sub(F.max("date"), days).alias("since"))


def fresh_part(existing: DataFrame, source: DataFrame, days: int = OVERLAP_DAYS) -> DataFrame:
    """What an update reads of a source: the overlap and what is new, all of a new symbol."""
    since = overlap_start(existing, days)
    return (
        source.join(since, "symbol", "left")
        .where(F.col("since").isNull() | (F.col("date") >= F.col("since")))
        .drop("since")
    )


PENDING = "pending"


def pending_root(root: str) -> str:
    return f"{root.rstrip('/')}-{PENDING}"


def held_back(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Rows of restated symbols that wait for a reload, from earlier batches.

    A symbol's rows wait until a later reload of the symbol is stored.
    """
    waiting = read_increments(spark, pending_root(root), before)
    done = last_reloads(zones(spark, root, _before(snapshot(spark, root), before)))
    return (
        waiting.join(done, "symbol", "left")
        .where(F.col("__since").isNull() | (F.col("batch") > F.col("__since")))
        .drop("__since")
    )


def _merged(rows: DataFrame) -> DataFrame:
    """The newest revisions of neighbouring parts; a symbol keeps the batch of its last reload among them."""
    reloads = last_reloads(rows)
    bars = newest_revisions(rows, reloads).join(reloads, "symbol", "left").withColumnRenamed("__since", "reloaded")
    bare = reloads.join(bars.select("symbol"), "symbol", "left_anti").withColumnRenamed("__since", "reloaded")
    return bars.unionByName(bare, allowMissingColumns=True)


def merge_tiers(spark: SparkSession, root: str, tier: int = TIER) -> list[Part]:
    """Merge neighbouring increments of like size until no ``tier`` of them are left side by side.

    Sizes are classed by powers of ``tier``, so every bar is written again
    logarithmically often and a store has logarithmically many parts.  The last
    increment stays as it is, since it may be repeated.  What waits beside the
    store is not touched.  Returns the parts of the published version.
    """
    while True:
        parts = snapshot(spark, root)
        rows = zones(spark, root, parts).groupBy("run", "batch").agg(F.sum("n_rows").alias("n")).collect()
        size = {Part(r["run"], r["batch"]): r["n"] for r in rows}
        alike = groupby(parts[:-1], lambda p: int(math.log(max(size.get(p, 0), 1), tier) + 1e-9))
        group = next((g for g in (list(g) for _, g in alike) if len(g) >= tier), None)
        if group is None:
            return parts
        merged = Part(versions(spark, root)[-1] + 1, group[-1].batch)
        _write_part(_merged(read_parts(spark, root, group)), root, merged, stored_buckets(spark, root) or BUCKETS)
        _publish(spark, root, [merged if p == group[-1] else p for p in parts if p == group[-1] or p not in group])


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[Part]:
    """Delete the parts and lists of all but the last ``keep`` versions; returns the deleted parts.

    Readers that hold an older version fail from then on.
    """
    known = versions(spark, root)
    held = {p for v in known[-keep:] for p in snapshot(spark, root, v)}
    gone = sorted({p for v in known[:-keep] for p in snapshot(spark, root, v)} - held)
    paths = [f for p in gone for f in (p.folder(root), p.folder(f"{root.rstrip('/')}/_manifest"))]
    for path in [*paths, *[f"{root.rstrip('/')}/_versions/{v}" for v in known[:-keep]]]:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return gone


def compact(spark: SparkSession, root: str, target: str, buckets: int = BUCKETS) -> None:
    """Write the current panel as the only batch of a new store, with the rows that wait beside it.

    The batch keeps the number of the last one, so that later increments go on
    from there.
    """
    if root.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact into a new folder; the old one is being read")
    parts = snapshot(spark, root)
    last = parts[-1].batch if parts else 0
    waiting = newest_revisions(held_back(spark, root))
    write_batch(waiting, pending_root(target), last, MERGE, buckets)
    write_batch(newest_revisions(read_parts(spark, root, parts)), target, last, MERGE, buckets)
