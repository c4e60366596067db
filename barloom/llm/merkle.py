"""A Merkle manifest of panel rows: digests, proofs and their check, level by level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import scratch
from barloom.functions.ranks import positions
from barloom.llm.common import stored

#: Fields of a panel row that enter its leaf, and consecutive nodes below one parent.
BAR_FIELDS = ("symbol", "date", "open", "high", "low", "close", "adj_close", "volume")
FAN_OUT = 16

_STEP = "array<struct<left:binary,right:binary>>"


def record_digest(fields: Sequence[str | Column]) -> Column:
    """Lowercase SHA-256 hex over the fields: ``-`` for null, else byte count, ``:`` and value as text."""
    parts = []
    for field in fields:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(
        path, leaf, lambda digest, step: F.sha2(F.concat(_text(step["left"]), digest, _text(step["right"])), 256)
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 hex of all siblings of a path, level by level, left to right."""
    level = F.transform(path, lambda step: F.concat(_text(step["left"]), _text(step["right"])))
    return F.sha2(F.array_join(level, ""), 256)


def _siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Nodes ``(tree, at, n, digest, record)`` with the digests of their siblings, ``left`` and ``right``.

    Every node computes the numbers of the other slots of its run and equijoins
    the nodes of those numbers; at most ``fan_out - 1`` digests come back to it.
    The rows of a run meet in one task, where the path of its parent joins them.
    """
    if fan_out == 2:
        wanted = F.array(F.col("at").bitwiseXOR(F.lit(1).cast("bigint")))
    else:
        first = F.col("at") - F.col("at") % fan_out
        slots = F.sequence(F.lit(0), F.lit(fan_out - 1))
        wanted = F.filter(F.transform(slots, lambda o: first + o), lambda i: i != F.col("at"))
    asking = nodes.select("tree", "at", F.explode(F.filter(wanted, lambda i: i < F.col("n"))).alias("want"))
    given = nodes.select("tree", F.col("at").alias("want"), F.col("digest").alias("sibling"))
    found = asking.join(given, ["tree", "want"])
    # the node itself goes along, so that a run of one is kept
    rows = found.unionByName(nodes, allowMissingColumns=True)

    def side(keep) -> Column:
        return F.aggregate(
            F.filter("near", keep), F.lit(b""), lambda digests, s: F.concat(digests, s["sibling"])
        )

    return (
        rows.withColumn("run", F.floor(F.col("at") / fan_out)).repartition("tree", "run").groupBy("tree", "run", "at")
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "digest", "record")],
            F.collect_list(F.when(F.col("want").isNotNull(), F.struct("want", "sibling"))).alias("near"),
        )
        .withColumn("near", F.array_sort("near"))
        .select(
            "tree", "run", "at", "n", "digest", "record",
            side(lambda s: s["want"] < F.col("at")).alias("left"), side(lambda s: s["want"] > F.col("at")).alias("right"),
        )
    )


def _grow(nodes: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees with siblings, and their tops ``(tree, height, digest)``."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        below = nodes.where("n > 1")
        if below.isEmpty():
            break
        levels.append(stored(_siblings(below, fan_out)))
        parent = F.unhex(F.sha2(F.concat(_text(F.col("left")), _text(F.col("digest")), _text(F.col("right"))), 256))
        nodes = stored(
            levels[-1].where(F.col("at") % fan_out == 0).select(
                "tree", F.col("run").alias("at"), F.ceil(F.col("n") / fan_out).alias("n"), parent.alias("digest"),
                F.lit(None).cast("string").alias("record"),
            )
        )
    return levels, stored(reduce(DataFrame.unionByName, tops))


def _prove(levels: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """Lowest nodes of the trees with levels, with ``subroot`` and the ``path`` to the root.

    ``above`` has ``(tree, height, subroot, path)`` of every top; paths go down
    level by level, each run taking that of its parent.
    """
    out = None
    for height in range(len(levels), 0, -1):
        begun = above.where(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("run"), "subroot", "path")
        known = begun if out is None else out.select("tree", F.col("at").alias("run"), "subroot", "path").unionByName(begun)
        step = F.array(F.struct("left", "right")).cast(_STEP)
        out = levels[height - 1].join(known, ["tree", "run"]).select(
            "tree", "at", "record", "subroot", F.concat(step, "path").alias("path")
        )
    return out


def panel_manifest(
    panel: DataFrame,
    symbol: str = "symbol",
    order: Sequence[str] = ("date",),
    fields: Sequence[str | Column] = BAR_FIELDS,
    fan_out: int = FAN_OUT,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Panel rows with ``leaf``, ``subroot``, ``root`` and the ``path`` that proves them.

    A leaf is ``record_digest`` of the row's fields.  Per symbol the leaves
    stand in the given order; while several nodes remain, every ``fan_out``
    consecutive ones (the last run may be shorter, even one) become the SHA-256
    of their hex digests.  What remains is the symbol's ``subroot``; the
    subroots, by symbol with null first, become the ``root`` in the same way.
    ``path`` has one step per level, from the leaf to the root: the digests of
    the siblings ``left`` and ``right`` of the node.  ``fold(leaf, path)`` gives
    the root as long as the row is untouched.

    * A null field is ``-`` and differs from an empty one; rows without a symbol
      are a symbol of their own, the first; a null in ``order`` sorts first.
    * Rows that tie in the order stand by their leaf; equal rows keep a place
      and a path each.
    * A table without rows gives none.  Columns other than ``fields`` take no part;
      ``carry`` names those to return besides symbol and order (default: all).
      Those called like a result are replaced by it.
    * Levels are tables: a symbol with most rows spans many tasks, and a task
      holds runs of ``fan_out`` nodes only.
    """
    results = ("leaf", "subroot", "root", "path")
    wanted = panel.columns if carry is None else (symbol, *order, *carry)
    kept = [c for c in panel.columns if c in wanted and (c.lower() not in results or c in (symbol, *order))]
    place, tree, n, shown, leaf = scratch(panel.columns, "place", "tree", "n", "shown", "leaf")
    rows = stored(
        positions(
            panel.select(*kept, F.col(symbol).alias(shown), record_digest(fields).alias(leaf)), [shown], [*order, leaf], place
        )
    )
    symbols = positions(rows.groupBy(shown).agg(F.count(F.lit(1)).alias(n)), [], [shown], tree)
    symbols = stored(symbols.withColumnRenamed(shown, f"{shown}_s"))
    nodes = rows.join(symbols, F.col(shown).eqNullSafe(F.col(f"{shown}_s"))).select(
        (F.col(tree) - 1).alias("tree"), (F.col(place) - 1).alias("at"), F.col(n).alias("n"),
        F.unhex(leaf).alias("digest"), F.struct(*kept, leaf).alias("record"),
    )
    nodes = stored(nodes)
    levels, tops = _grow(nodes, fan_out)
    upper = tops.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(symbols.count()).cast("bigint").alias("n"),
        "digest", F.struct("tree", "height", F.col("digest").alias("subroot")).alias("record"),
    )
    upper_levels, top = _grow(stored(upper), fan_out)
    found = top.first()
    root = None if found is None else bytes(found["digest"]).hex()
    nothing = F.array().cast(_STEP).alias("path")
    ground = top.select("tree", "height", F.col("digest").alias("subroot"), nothing)
    over = _prove(upper_levels, ground)
    over = upper.select("record", nothing) if over is None else over.select("record", "path")
    over = stored(over.select("record.*", "path"))
    alone = nodes.where("n = 1").join(over.where("height = 0"), "tree").select("tree", "at", "record", "subroot", "path")
    proven = _prove(levels, over)
    proven = alone if proven is None else proven.unionByName(alone)
    return proven.select(
        *[F.col("record")[c].alias(c) for c in kept], F.col("record")[leaf].alias("leaf"), _text(F.col("subroot")).alias("subroot"),
        F.lit(root).alias("root"), "path",
    )
