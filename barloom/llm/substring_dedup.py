"""Repeated passages of research reports, found with compressed full-text indexes.

Every window of ``WINDOW`` words is assigned to the smallest hash among its
runs of ``ANCHOR`` words.  Windows with equal words have equal anchors, so a
shard that holds all pieces of its anchors can decide about them alone.  A
shard builds an FM-index over its pieces and streams the pieces through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import any_key, byte_view, mix, runs_of, slices, stored, word_hashes
from barloom.llm.fm_index import PassageIndex

#: Words of a window that counts as repeated, and of the runs that anchor it.
WINDOW, ANCHOR = 50, 16

#: Words of one index; words wanted in a shard; pieces of an anchor from which it is dealt out.
INDEX, SHARD, HOT = 1 << 19, 1 << 19, 8192


def _sequence_marks(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a word sequence."""
    if not len(words):
        return 0, 0
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(words + place * np.uint64(0x9E3779B97F4A7C15)))
        b = np.add.reduce(mix(words ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = byte_view(batch.column("report"))
    for lo, hi in slices(offsets):
        hashes, first = word_hashes(data, offsets[lo : hi + 1], fold_case=False)
        for i in range(lo, hi):
            yield i, hashes[first[i - lo] : first[i - lo + 1]]


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each piece of a report."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none
    runs = runs_of(words, ANCHOR)
    span = WINDOW - ANCHOR + 1
    pick = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(runs) - span + 1)
    place, first, count = np.unique(pick, return_index=True, return_counts=True)
    return runs[place].view(np.int64), first, count


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(w), *_sequence_marks(w)) for _, w in _words(batch)]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("report_id"), *(pa.array(c, pa.int64()) for c in columns)],
            ["report_id", "n_words", "mark", "mark2"],
        )


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[int] = set()
        tokens, owner = [], []
        for _, w in _words(batch):
            if len(w) >= WINDOW and (mark := _sequence_marks(w)[0]) not in seen:
                seen.add(mark)
                tokens.append(np.unique(anchors(w)[0]))
                owner.append(np.full(len(tokens[-1]), mark))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owner))], ["anchor", "mark"]
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces around shared anchors, with the hashes of their words."""
    names = ["anchor", "report_id", "first", "n", "content", "words"]
    types = (*[pa.int64()] * 5, pa.binary())
    for batch in batches:
        ids, wanted = batch.column("report_id").to_pylist(), batch.column("anchors")
        marks = batch.column("mark").to_pylist()
        rows: list[tuple] = []
        for i, w in _words(batch):
            mark, mark2 = _sequence_marks(w)
            if mark != marks[i]:
                continue
            token, first, count = anchors(w)
            use = np.isin(token, np.asarray(wanted[i].as_py(), np.int64))
            for a, f, c in zip(token[use].tolist(), first[use].tolist(), count[use].tolist()):
                part = w[f : f + c + WINDOW - 1]
                rows.append((a, ids[i], f, len(part), _sequence_marks(part)[0], part.astype("<u8").tobytes()))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _repeats(rows: pa.Table) -> pa.Table:
    """Of each asking piece of a shard: from where to where smaller reports have its windows.

    Windows of a piece overlap, so the first and the last one that repeat span
    all words that repeat; the last is the first of the reversed pieces in the
    reversed index.
    """
    anchor = rows.column("anchor").to_numpy()
    order = np.argsort(anchor, kind="stable")
    ids = rows.column("report_id").to_numpy()[order]
    first = rows.column("first").to_numpy()[order]
    indexed = rows.column("indexed").to_numpy(zero_copy_only=False)[order]
    asks = rows.column("asks").to_numpy(zero_copy_only=False)[order]
    raw = rows.column("words").to_pylist()
    words = [np.frombuffer(raw[i], "<u8") for i in order]
    anchor = anchor[order]
    _, owners = np.unique(ids, return_inverse=True)
    low = np.full(len(ids), -1, np.int64)
    high = np.full(len(ids), -1, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lo = 0
    while lo < len(ids):
        # whole anchors up to the size of an index; a larger anchor is taken in several indexes
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), INDEX, "right")) + lo)
        if hi < len(ids):
            cut = int(np.searchsorted(anchor, anchor[hi], "left"))
            hi = cut if cut > lo else int(np.searchsorted(anchor, anchor[lo], "right"))
        query = np.flatnonzero(asks[lo:hi]) + lo
        source = np.flatnonzero(indexed[lo:hi]) + lo
        for at in range(0, len(source), max(1, HOT)):
            part = source[at : at + max(1, HOT)]
            if not len(query):
                break
            for back in (False, True):
                turn = (lambda x: x[::-1]) if back else (lambda x: x)
                index = PassageIndex([turn(words[i]) for i in part], owners[part])
                found = index.first_repeat([turn(words[i]) for i in query], owners[query], WINDOW)
                hit = found >= 0
                q, f = query[hit], found[hit]
                if back:
                    high[q] = np.maximum(high[q], sizes[q] - f)
                else:
                    low[q] = np.where(low[q] < 0, f, np.minimum(low[q], f))
        lo = hi
    hit = low >= 0
    return pa.table({
        "report_id": pa.array(ids[hit], pa.int64()),
        "lo": pa.array((first + low)[hit], pa.int64()),
        "hi": pa.array((first + high)[hit], pa.int64()),
    })


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports without the covered words."""
    for batch in batches:
        data, offsets = byte_view(batch.column("report"))
        spans = batch.column("spans")
        for lo, hi in slices(offsets, 1 << 22):
            kept, total, removed = [], [], []
            for i in range(lo, hi):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                cover = spans[i].as_py()
                total.append(len(words))
                if cover:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in cover:
                        edge[min(s["lo"], len(words))] += 1
                        edge[min(s["hi"], len(words))] -= 1
                    free = np.cumsum(edge[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(free)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("report_id").slice(lo, hi - lo), pa.array(total, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["report_id", "n_words", "n_removed", "kept"],
            )


@any_key("report_id")
def remove_repeats(reports: DataFrame) -> DataFrame:
    """Reports ``(report_id, report)`` without passages that a smaller id has already.

    A word goes when a window of ``WINDOW`` consecutive words covers it whose
    words, in order, also occur in a report with a smaller id; windows are
    judged on the input.  Words are runs without blanks, unchanged.  Returns
    ``report_id, n_words, n_removed, kept`` (the kept words joined by a blank).

    * Reports with equal word sequences are one class; all but the smallest id
      of a class lose everything from ``WINDOW`` words on.
    * Equal pieces are indexed once, with their smallest report.  An anchor with
      very many different pieces is dealt over several groups, every asking part
      against every indexed part.
    * Null, empty and short reports lose nothing.  Rows that repeat id and text
      give equal results; of rows that repeat an id only, what is found in one
      is cut from each.  Hashes of words have 64 bits.
    * An empty table gives an empty result; other columns are ignored.
    """
    reports = reports.select(F.col("report_id").cast("bigint"), F.col("report").cast("string"))
    same = ["n_words", "mark", "mark2"]
    described = stored(
        reports.mapInArrow(_describe, "report_id bigint, n_words bigint, mark bigint, mark2 bigint")
    ).where(F.col("n_words") >= WINDOW)
    classes = stored(described.groupBy(same).agg(F.min("report_id").alias("first_id")))
    rest = described.join(classes, same).where("report_id > first_id")
    covers = rest.select("report_id", F.lit(0).cast("bigint").alias("lo"), F.col("n_words").alias("hi"))

    anchored = stored(reports.mapInArrow(_anchor_rows, "anchor bigint, mark bigint"))
    shared = stored(
        anchored.groupBy("anchor").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
        .where("a < b").select("anchor")
    )
    wanted = anchored.join(shared, "anchor").groupBy("mark").agg(F.collect_set("anchor").alias("anchors"))
    of_report = stored(
        classes.join(wanted, "mark").select(F.col("first_id").alias("report_id"), "mark", "anchors")
    )
    pieces = stored(
        reports.join(of_report, "report_id").mapInArrow(
            _pieces,
            "anchor bigint, report_id bigint, first bigint, n bigint, content bigint, words binary",
        )
    )
    content = ["anchor", "content", "n"]
    sources = stored(pieces.groupBy(content).agg(F.min("report_id").alias("source")))
    placed = pieces.join(sources, content)
    covers = covers.unionByName(
        placed.where("report_id > source").select(
            "report_id", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi")
        )
    )
    different = stored(
        sources.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").withColumn(
            "parts", F.ceil(F.col("pieces") / HOT)
        )
    )
    total = placed.where("report_id = source").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    asking = placed.where("report_id = source").join(different, "anchor")
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.col("anchor"))
    own = F.pmod(F.xxhash64("content"), "parts")
    columns = ["anchor", "report_id", "first", "words"]
    once = asking.where("parts = 1").select(
        shard.alias("shard"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), *columns,
        F.lit(True).alias("indexed"), F.lit(True).alias("asks"),
    )
    hot = asking.where("parts > 1").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    dealt = once.unionByName(
        hot.select(F.col("anchor").alias("shard"), F.col("own").alias("i"), F.col("other").alias("j"), *columns,
                   F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    ).unionByName(
        hot.select(F.col("anchor").alias("shard"), F.col("other").alias("i"), F.col("own").alias("j"), *columns,
                   F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
    )
    found = stored(
        dealt.groupBy("shard", "i", "j").applyInArrow(_repeats, "report_id bigint, lo bigint, hi bigint")
    )
    spans = stored(
        covers.unionByName(found).groupBy("report_id").agg(
            F.collect_set(F.struct("lo", "hi")).alias("spans")
        )
    )
    return reports.join(spans, "report_id", "left").mapInArrow(
        _cut, "report_id bigint, n_words bigint, n_removed bigint, kept string"
    )
