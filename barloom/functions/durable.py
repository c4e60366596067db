"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  A temporary folder is
    chosen only for a local session, where every task sees the same disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="barloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    For frames that iterative fits scan many times: a lost executor re-reads
    files instead of recomputing the features.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet below the checkpoint folder: written once, read with pruned columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as Parquet files by hash of ``key``: joins and groups on it need no exchange of these rows.

    Rows are shuffled once and every bucket is one file, with small row groups
    where rows are large.  The catalog entry that tells the reader about the
    buckets is dropped at once; the files stay below the checkpoint folder.
    """
    spark = df.sparkSession
    name = f"barloom_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-buckets/{name}")
        .option("compression", "zstd")
        .option("parquet.block.size", 1 << 24)
        .saveAsTable(name)
    )
    out = spark.table(name)
    out.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return out
