"""Exact duplicates of research reports by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, any_key, byte_view, narrowed, stored

#: Bytes hashed, and later compared, as one unit.
CHUNK = 1 << 14

#: Two primes under 2**31 and a base for each: products of a chunk stay under 2**63.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525029)

#: Bits of a fingerprint; fewer only make collisions that the comparison must settle.
BITS = 62

_TABLES: dict[int, np.ndarray] = {}


def _table(which: int) -> np.ndarray:
    """base ** (CHUNK - 1 - i) modulo the prime, for i = 0 .. CHUNK - 1."""
    if which not in _TABLES:
        p, m = BASES[which], MODULI[which]
        powers = [1]
        for _ in range(CHUNK - 1):
            powers.append(powers[-1] * p % m)
        _TABLES[which] = np.array(powers[::-1], np.uint64)
    return _TABLES[which]


def combine(left: int, right: int, right_length: int, which: int) -> int:
    """Fingerprint of a text from those of its two parts: shift by a length, add."""
    m = MODULI[which]
    return (left * pow(BASES[which], right_length, m) + right) % m


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both polynomial hashes of ``data``; byte values are shifted by one.

    The chunks are hashed independently, as the rows of one matrix product, and
    folded with ``combine``.
    """
    units = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    whole = len(units) // CHUNK
    out = []
    for which, m in enumerate(MODULI):
        powers = _table(which)
        h = 0
        if whole:
            for part in (units[: whole * CHUNK].reshape(whole, CHUNK) @ powers) % np.uint64(m):
                h = combine(h, int(part), CHUNK, which)
        rest = units[whole * CHUNK :]
        if len(rest):
            h = combine(h, int((rest @ powers[CHUNK - len(rest) :]) % np.uint64(m)), len(rest), which)
        out.append(h)
    return out[0], out[1]


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bytes]]:
    data, offsets = byte_view(batch.column("report"))
    for i in range(len(offsets) - 1):
        raw = data[offsets[i] : offsets[i + 1]]
        yield i, raw, raw.tobytes().translate(None, BLANKS)


def _folded(text: bytes, bits: int) -> int:
    a, b = fingerprint(text)
    return (a << 31 | b) >> (BITS - bits)


def _fingerprints(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, raw, text in _normalised(batch):
                points = int(np.count_nonzero((raw & 0xC0) != 0x80))
                rows.append((_folded(text, bits), len(text), points, hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("report_id"), *(pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                ["report_id", "fingerprint", "n_bytes", "n_points", "text_sha256"],
            )

    return emit


def _chunks(bits: int):
    names = ["fingerprint", "n_bytes", "chunk_no", "chunk"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for _, _, text in _normalised(batch):
                mark = _folded(text, bits)
                for k, at in enumerate(range(0, len(text), CHUNK)):
                    rows.append((mark, len(text), k, text[at : at + CHUNK]))
                held += len(text)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return emit


@any_key("report_id", "keep_id")
def exact_duplicates(reports: DataFrame, bits: int = BITS) -> DataFrame:
    """Group reports ``(report_id, report)`` whose text is equal without white space.

    Of a group the report with the most code points stays, then the smallest
    id.  Returns one row per input row: ``report_id, keep_id, group_size, kept,
    text_sha256`` (of the text without white space).

    * Equality is proposed by two polynomial fingerprints (62 bits) and the
      length, then proven: the chunks of all reports that share a fingerprint
      are compared as streams, by the smallest and largest content at each
      position, which is combined before the shuffle.  Where they differ the
      group is divided by content.
    * A null text is an empty text; empty texts are equal to each other.
    * Rows that repeat both id and text are each returned, with equal values.
    * An empty table gives an empty result; other columns are ignored.
    """
    reports = reports.select(F.col("report_id").cast("bigint"), F.col("report").cast("string"))
    prints = stored(
        reports.mapInArrow(
            _fingerprints(bits),
            "report_id bigint, fingerprint bigint, n_bytes bigint, n_points bigint, text_sha256 string",
        )
    )
    same = ["fingerprint", "n_bytes"]
    shared = stored(prints.groupBy(same).count().where("count > 1 AND n_bytes > 0").drop("count"))
    suspects = stored(prints.join(shared, same, "left_semi").select("report_id").distinct())
    unequal = stored(
        narrowed(reports, suspects, "report_id")
        .join(suspects, "report_id", "left_semi")
        .mapInArrow(_chunks(bits), "fingerprint bigint, n_bytes bigint, chunk_no bigint, chunk binary")
        .groupBy(*same, "chunk_no")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("low <> high")
        .select(same)
        .distinct()
    )
    if unequal.isEmpty():
        prints = prints.withColumn("content", F.lit(""))
    else:
        marked = unequal.withColumn("differs", F.lit(True))
        prints = prints.join(marked, same, "left").withColumn(
            "content", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")
        )
    same = [*same, "content"]
    groups = stored(
        prints.groupBy(same).agg(
            F.max(F.struct("n_points", (-F.col("report_id")).alias("order"), "report_id")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        ).select(*same, F.col("best.report_id").alias("keep_id"), "group_size")
    )
    return prints.join(groups, same).select(
        "report_id",
        "keep_id",
        "group_size",
        F.col("report_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
