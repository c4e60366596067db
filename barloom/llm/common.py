"""Helpers shared by the operators: tables, written intermediates, byte views, word hashes."""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import scratch
from barloom.functions.durable import ensure_checkpoint_dir
from barloom.functions.ranks import positions
from barloom.functions.session import ship

#: White space of every word contract: blank and 0x09 to 0x0D.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of text hashed in one numpy step; bounds the memory of a task.
SLICE = 1 << 18


#: The C library where it can trim its heap (glibc).
_libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
_libc = _libc if hasattr(_libc, "malloc_trim") else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_reports(documents: DataFrame) -> DataFrame:
    """Documents under the field names of the library's report records."""
    return documents.select(F.col("doc_id").alias("report_id"), F.col("text").alias("report"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/barloom-llm/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files.

    Later reads prune columns, know the size, and survive lost executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "steps")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def any_key(*columns: str):
    """Let an operator on integer ``report_id`` take reports under keys of any ordered type.

    Keys are numbered in their order, so that "smallest" means the same, and
    ``columns`` of the result (those that hold ids) get their keys back.  Null
    keys stay null.  Integer ids pass through as they are.
    """

    def wrap(operator):
        @wraps(operator)
        def run(reports: DataFrame, *args, **options) -> DataFrame:
            ship(reports.sparkSession)
            kind = dict(reports.dtypes).get("report_id")
            if kind in ("tinyint", "smallint", "int", "bigint"):
                return operator(reports, *args, **options)
            key, number = scratch(reports.columns, "key", "number")
            keys = reports.select(F.col("report_id").alias(key)).where(F.col(key).isNotNull()).distinct()
            keys = stored(positions(keys, [], [key], number))
            rest = [c for c in reports.columns if c != "report_id"]
            numbered = reports.join(keys, F.col("report_id") == F.col(key), "left").select(
                F.col(number).alias("report_id"), *rest
            )
            out = operator(numbered, *args, **options)
            names = out.columns
            for c in columns:
                back = keys.select(F.col(number).alias(c), F.col(key).alias(f"{key}_of"))
                out = out.join(back, c, "left").drop(c).withColumnRenamed(f"{key}_of", c)
            return out.select(*names)

        return run

    return wrap


#: Bytes of rows that go to a Python worker at once in ``batch_limit``.
BATCH = 1 << 22


@contextmanager
def batch_limit(spark: SparkSession) -> Iterator[None]:
    """Hand rows to Python workers in batches of about ``BATCH`` bytes.

    Spark keeps a batch in several copies outside the heap, and a worker another,
    so by its own limit a group of packed arrays takes a multiple of its size.
    Results do not depend on it.  It holds inside the block, so the Python
    steps must be written before its end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(operator):
    """An operator on reports that runs within ``batch_limit``."""

    @wraps(operator)
    def run(reports: DataFrame, *args, **options) -> DataFrame:
        with batch_limit(reports.sparkSession):
            return operator(reports, *args, **options)

    return run


#: Bits of the filter in ``narrowed``: a fixed size, whatever the data.
FILTER_BITS = 1 << 23


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones, by a bitmap of fixed size.

    It goes before an exact join, so that texts nobody wants are not shuffled.
    Its rows are at most ``FILTER_BITS / 64``, which bounds the broadcast; when
    the bitmap is full it lets everything pass and the join does all the work.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word = F.shiftrightunsigned(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    bitmap = stored(
        wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    )
    return rows.join(
        F.broadcast(bitmap), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi"
    )


def release_memory() -> None:
    """Give memory freed since the last batch back to the system.

    Python workers live on from stage to stage; without this each keeps the
    most that any batch of any stage needed.
    """
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    release_memory()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    view = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return view, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


_rng = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE * 2, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(
                np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64) for x in (_ODD, _INVERSE)
            )
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold_case: bool
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts and where each text's words begin.

    Returns ``(hashes, first)``: the words of row ``i`` are
    ``hashes[first[i]:first[i + 1]]``.  Words are maximal runs without blanks;
    with ``fold_case`` A-Z count as a-z.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    power, inverse = _power_tables(n)
    inside = ~_IS_BLANK[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1] - lo
    edges = at[at < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        value = (_FOLDED if fold_case else _VALUE)[b] * power[:n]
        value[~inside] = 0
        sums = np.add.reduceat(value, starts)
        hashes = mix(sums * inverse[starts])
    first = np.searchsorted(starts, offsets - lo)
    return hashes, first


_SHINGLE_WEIGHTS = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes; one row's words only."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += words[i : i + n] * _SHINGLE_WEIGHTS[i]
        return mix(total)
