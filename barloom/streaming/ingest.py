"""File stream of bar increments into the panel store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barloom.functions.durable import checkpointed
from barloom.operators.cleaning import FIELDS
from barloom.sources.panel_store import (
    BUCKETS,
    MERGE,
    RELOAD,
    held_back,
    merge_newest,
    merge_tiers,
    newest_revisions,
    pending_root,
    stored_restatements,
    write_batch,
)
from barloom.sources.raw_bars import normalise, number_arrivals, with_source
from barloom.sources.ticks import bar_aggregates, bar_fields


def merge_increment(
    spark: SparkSession,
    fresh: DataFrame,
    root: str,
    batch: int,
    full_history: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Store one normalised increment; returns the symbols that were restated.

    A restated symbol's increment rows are replaced by its whole history from
    ``full_history`` (given the restated symbols), marked as a reload, so no
    row of the old basis survives on read.  Without that source, and for
    symbols it has nothing of, the increment rows are stored beside the panel
    as pending; the next reload of the symbol brings them in, where it has no
    newer row of its own.  No landed row is lost.

    ``fresh`` is computed once and written: the checks and both stores read it.
    """
    fresh = checkpointed(fresh)
    # A batch that is being repeated must not see its own first attempt.
    waiting = held_back(spark, root, batch)
    moved = checkpointed(
        stored_restatements(spark, root, fresh, batch)
        .where("restated")
        .join(waiting.select("symbol").distinct(), "symbol", "full")
        .where(F.col("restated").isNotNull() | F.lit(full_history is not None))
    )
    keep = fresh.join(moved.select("symbol"), "symbol", "left_anti").withColumn(
        "kind", F.lit(MERGE)
    )
    late = fresh.join(moved.select("symbol"), "symbol", "left_semi")
    if full_history is not None:
        again = checkpointed(full_history(moved.select("symbol")).select("symbol", "date", *FIELDS))
        known = again.select("symbol").distinct()
        old = newest_revisions(waiting).join(known, "symbol", "left_semi")
        reload = merge_newest(old, merge_newest(late.join(known, "symbol", "left_semi"), again))
        keep = keep.unionByName(reload.withColumn("kind", F.lit(RELOAD)).select(*keep.columns))
        late = late.join(known, "symbol", "left_anti")
    write_batch(late, pending_root(root), batch, buckets=buckets)
    write_batch(keep, root, batch, buckets=buckets)
    return moved.where(F.col("restated")).select("symbol", "shared_date", "old_basis", "new_basis", "restated")


def ingest_bars(
    spark: SparkSession,
    landing: str,
    schema: StructType | str,
    root: str,
    checkpoint: str,
    fmt: str = "parquet",
    full_history: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
    **normalise_options,
) -> StreamingQuery:
    """Take in every file that landed since the last run, then stop.

    The stream's checkpoint remembers the files; the batch number names the
    increment, so a batch cut short is written again in the same place.
    """
    stream = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        stream = stream.option("header", True)

    def take(batch_df: DataFrame, batch: int) -> None:
        fresh = normalise(number_arrivals(batch_df), **normalise_options)
        merge_increment(batch_df.sparkSession, fresh, root, batch, full_history, buckets)
        merge_tiers(batch_df.sparkSession, root)

    return (
        with_source(stream.load(landing))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_bars(ticks: DataFrame, every: str, delay: str) -> DataFrame:
    """Ticks of a stream to closed bars, with the columns and values of the batch form.

    A bar comes out once no tick older than ``delay`` can still change it.
    Weeks begin on Monday, as in batch.
    """
    width, offset = {"hour": ("1 hour", "0 hours"), "day": ("1 day", "0 hours"), "week": ("7 days", "4 days")}[every]
    start = F.col("__w.start")
    return (
        ticks.withWatermark("ts", delay)
        .withColumn("__w", F.window("ts", width, startTime=offset))
        .groupBy("symbol", "__w")
        .agg(*bar_aggregates())
        .select("symbol", (start if every == "hour" else F.to_date(start)).alias("date"), *bar_fields())
    )
