"""The prefix trie of sectioned reports, by ROLLUP over positional columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import positions
from barloom.llm.common import stored

#: Positional columns of a block, and blocks whose sums one window adds up.
WIDTH, SUPER = 8, 4096

#: Reports whose ids are joined to one text before a digest reads them.
BUCKET = 4096

_WHOLE = "decimal(38,0)"


def report_parts(sections: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Report rows ``(keys, section, item, value)`` as ordered parts ``(keys, position, section, body)``.

    Sections stand in the order of their names, as in ``report_text``; a body
    has one line per item.
    """
    line = F.concat(F.coalesce("item", F.lit("")), F.lit(": "), F.coalesce("value", F.lit("n/a")))
    return sections.groupBy(*keys, "section").agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body")
    ).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("section")))


def _marks(place: Column, part: Column) -> list[Column]:
    """Two 64-bit numbers that stand for a part at a place; a prefix is their sums."""
    return [F.xxhash64(F.lit(seed), place, part).cast(_WHOLE) for seed in (11, 29)]


def _block_rows(parts: DataFrame, width: int) -> DataFrame:
    """One row per report and block of ``width`` parts.

    ``node`` names the block's number and the sequence of all parts before it;
    ``p1 ...`` have a part each, its identity and code points, null behind the
    last; ``before`` counts the code points before the block.
    """
    size = F.octet_length("section")
    identity = F.substring(F.unhex(F.sha2(F.concat(size, F.lit(":"), "section", "body"), 256)), 1, 16)
    parts = parts.where("report_id IS NOT NULL").select(
        "report_id", "position", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("body", F.lit("")).alias("body")
    ).select("report_id", "position", F.struct(identity.alias("part"), F.length("body").alias("chars")).alias("p"))
    placed = positions(parts, ["report_id"], ["position", "p"], "place")
    block = F.floor((F.col("place") - 1) / width)
    slot = (F.col("place") - 1) % width
    first, second = _marks(F.col("place"), F.col("p.part"))
    blocks = stored(
        placed.groupBy("report_id", block.alias("block"), F.floor(block / SUPER).alias("super")).agg(
            *[F.max(F.when(slot == i, F.col("p"))).alias(f"p{i + 1}") for i in range(width)],
            F.sum(first).cast(_WHOLE).alias("m1"), F.sum(second).cast(_WHOLE).alias("m2"),
            F.sum("p.chars").cast(_WHOLE).alias("m3"), F.count(F.lit(1)).cast(_WHOLE).alias("m4"),
        )
    )
    # sums of all earlier blocks: within a super-block, and over super-blocks
    sums = ("m1", "m2", "m3", "m4")
    inside = Window.partitionBy("report_id", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("report_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("report_id")
    supers = blocks.groupBy("report_id", "super").agg(*[F.sum(m).cast(_WHOLE).alias(m) for m in sums])
    nil = F.lit(0).cast(_WHOLE)
    supers = supers.select(
        "report_id", "super", *[F.coalesce(F.sum(m).over(ahead), nil).alias(f"a{m}") for m in sums],
        F.sum("m3").over(everything).cast("bigint").alias("total"), F.sum("m4").over(everything).cast("bigint").alias("length"),
    )
    earlier = {m: F.col(f"a{m}") + F.coalesce(F.col(f"i{m}"), nil) for m in sums}
    return (
        blocks.withColumns({f"i{m}": F.sum(m).over(inside) for m in sums})
        .join(supers, ["report_id", "super"])
        .select(
            "report_id", F.struct("block", *[earlier[m].cast(_WHOLE).alias(m) for m in ("m1", "m2")]).alias("node"),
            earlier["m3"].cast("bigint").alias("before"), *[f"p{i + 1}" for i in range(width)], "total", "length",
        )
    )


def _rolled(rows: DataFrame, width: int, **measures: Column) -> DataFrame:
    """All prefixes of all blocks in one ROLLUP: ``depth``, the sums that name node and parent, and measures."""
    columns = [f"p{i + 1}" for i in range(width)]
    rolled = rows.rollup("node", *columns).agg(
        F.grouping_id().alias("bits"), F.count(F.lit(1)).alias("n_reports"), F.max("before").alias("before"),
        *[c.alias(name) for name, c in measures.items()],
    )
    # the first k columns are kept where width - k low bits are set
    kept = width - F.round(F.log2(F.col("bits") + 1)).cast("int")
    given = reduce(lambda a, c: a + F.col(c).isNotNull().cast("int"), columns, F.lit(0))
    rolled = rolled.withColumn("k", kept).where((F.col("k") >= 0) & (given == F.col("k")))
    # a block's own start is the node that ended the block before
    rolled = rolled.where((F.col("k") > 0) | (F.col("node.block") == 0))
    start = F.col("node.block") * width

    def named(upto: Column) -> list[Column]:
        sums = [F.col("node.m1"), F.col("node.m2")]
        for i, c in enumerate(columns):
            for j, mark in enumerate(_marks(start + i + 1, F.col(f"{c}.part"))):
                sums[j] = sums[j] + F.when(F.lit(i) < upto, mark).otherwise(F.lit(0))
        return [s.cast(_WHOLE) for s in sums]

    before = F.col("before")
    for i, c in enumerate(columns):
        before = before + F.when(F.lit(i) < F.col("k") - 1, F.col(f"{c}.chars")).otherwise(0)
    own, up = named(F.col("k")), named(F.col("k") - 1)
    return rolled.select(
        (start + F.col("k")).alias("depth"), own[0].alias("m1"), own[1].alias("m2"), up[0].alias("u1"), up[1].alias("u2"),
        "n_reports", before.cast("bigint").alias("before"), *measures,
    )


def prefix_trie(parts: DataFrame, reports: DataFrame | None = None, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The trie of all prefixes of reports, and the node at which each report ends.

    ``parts`` has a report's parts ``(report_id, position, section, body)``; a
    report is their sequence by position.  Each distinct sequence of the first d
    parts of a report is a node of depth d, from the root (d = 0, no text).
    ``reports`` may name further reports ``(report_id)`` that have no part.

    Returns nodes ``(report_id, depth, parent_report_id, n_reports, n_children,
    n_leaves, saved_chars)`` and ends ``(report_id, node_report_id, depth)``.  A
    node is named by its depth and the smallest report that starts with it;
    ``n_leaves`` counts childless nodes of its subtree, itself included, and
    ``saved_chars`` sums, over the subtree, the code points of a node's last
    body times the reports that share it less one: what a store saves by
    keeping each node once.

    * A null section or body is empty; a null position sorts first; parts that
      tie in position stand by an identity of their content, so repeated rows
      are parts of their own.  Rows without a report id belong to no report.
    * Ids are integers.  Further columns are left alone.  Without reports there
      is no node.
    * Sequences are named by sums of two 64-bit hashes of (place, part), a part
      by 128 bits of SHA-256.
    * ROLLUP over ``width`` positional columns counts all prefixes at once; a
      longer report goes on in further rows whose key is the node before.  A
      report with very many parts spans many tasks, and so does a node that most
      reports share, since its rows are combined before the shuffle.
    """
    rows = _block_rows(parts, width)
    if reports is not None:
        empty = reports.where("report_id IS NOT NULL").select("report_id").distinct().join(
            rows.select("report_id").distinct(), "report_id", "left_anti"
        )
        root = F.struct(
            F.lit(0).cast("bigint").alias("block"), *[F.lit(0).cast(_WHOLE).alias(m) for m in ("m1", "m2")]
        )
        rows = rows.unionByName(
            empty.select(
                F.col("report_id"), root.alias("node"), *[F.lit(0).cast("bigint").alias(c) for c in ("before", "total", "length")]
            ),
            allowMissingColumns=True,
        )
    rows = stored(rows)
    nodes = stored(_rolled(rows, width, low=F.min("report_id"), longest=F.max("length")))
    # a report is the smallest of its prefixes from one depth on; it owns those nodes
    owners = stored(
        nodes.groupBy(F.col("low").alias("report_id")).agg(
            F.min("depth").alias("since"), F.min_by("before", "depth").alias("before_since"),
            F.max(F.when(F.col("longest") == F.col("depth"), 1).otherwise(0)).alias("leaf"),
        )
    )
    # code points of owned nodes, and leaves, add up to those of any subtree; its own smallest report counts from its top
    facts = rows.join(owners.select("report_id", "before_since", "leaf"), "report_id", "left").select(
        *rows.columns, (F.coalesce(F.col("total") - F.col("before_since"), F.lit(0))).alias("owned"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    sums = _rolled(
        facts, width, top=F.min(F.struct("report_id", "total", "owned")), total=F.sum("total"), owned=F.sum("owned"),
        n_leaves=F.sum("leaf"),
    )
    shared = F.col("total") - F.col("n_reports") * F.col("before")
    once = F.col("owned") - F.col("top.owned") + F.col("top.total") - F.col("before")
    sums = stored(
        sums.select(
            F.col("top.report_id").alias("report_id"), "depth", "m1", "m2", "u1", "u2", "n_reports",
            F.col("n_leaves").cast("bigint").alias("n_leaves"), (shared - once).cast("bigint").alias("saved_chars"),
        )
    )
    below = sums.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("u1").alias("m1"), F.col("u2").alias("m2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    above = sums.select(
        (F.col("depth") + 1).alias("depth"), F.col("m1").alias("u1"), F.col("m2").alias("u2"),
        F.col("report_id").alias("parent_report_id"),
    )
    out = (
        sums.join(above, ["depth", "u1", "u2"], "left").join(below, ["depth", "m1", "m2"], "left")
        .select(
            "report_id", "depth", F.when(F.col("depth") > 0, F.col("parent_report_id")).alias("parent_report_id"), "n_reports",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_chars",
        )
    )
    return out, _ends(rows, sums, width)


def _ends(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(report_id, node_report_id, depth)``: the node of each whole report."""
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / width)
    sums = [F.col("node.m1"), F.col("node.m2")]
    for i in range(width):
        part = F.col(f"p{i + 1}.part")
        for j, mark in enumerate(_marks(F.col("node.block") * width + i + 1, part)):
            sums[j] = sums[j] + F.when(part.isNotNull(), mark).otherwise(F.lit(0))
    whole = rows.where(F.col("node.block") == last).select(
        "report_id", F.col("length").alias("depth"), sums[0].cast(_WHOLE).alias("m1"), sums[1].cast(_WHOLE).alias("m2")
    )
    owner = nodes.select("depth", "m1", "m2", F.col("report_id").alias("node_report_id"))
    return whole.join(owner, ["depth", "m1", "m2"]).select("report_id", "node_report_id", "depth")


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(node_report_id, depth, ends_sha256)``: SHA-256 hex of a node's ending ids, ascending, comma-joined.

    Ids go out in texts of at most ``BUCKET``; the texts of a node are read in
    order by one running digest, so no task holds all ids of a node.
    """
    bucket = F.floor(F.col("report_id") / BUCKET)
    texts = ends.groupBy("node_report_id", "depth", bucket.alias("bucket")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("report_id")), lambda i: i.cast("string")), ",").alias("ids")
    )
    key = ["node_report_id", "depth"]
    return texts.repartition(*key).sortWithinPartitions(*key, "bucket").mapInArrow(
        _run_digests, "node_report_id bigint, depth bigint, ends_sha256 string"
    )


def _run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    names = ["node_report_id", "depth", "ends_sha256"]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("node_report_id", "depth", "ids"))):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield rows(done)
    if node is not None:
        yield rows([(*node, state.hexdigest())])
