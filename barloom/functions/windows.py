"""Window helpers.

Scale note.  Ordered windows partition by ``symbol`` (plus finer keys).  After
:func:`barloom.operators.cleaning.keep_latest` a symbol owns at most one row
per bar interval, so a window partition is bounded by the calendar (about 366
rows a year for daily bars) and not by the number of ticks or of copies behind
the bars, however skewed those are.  Steps that see raw rows never use these
windows; they aggregate with map-side combine or go through
:func:`previous_in_arrival`, which works on bounded chunks.

All windows of one panel share ``partitionBy(symbol).orderBy(date)``.  Spark
then plans one exchange for the whole chain, and later windows keyed by
``(symbol, split | fold | grid point)`` reuse it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import col

KEYS = ("symbol",)


def by_date(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def roll(
    agg: Callable[[Column], Column],
    x: str | Column,
    n: int,
    w: WindowSpec,
    min_periods: int | None = None,
) -> Column:
    """Trailing ``n``-row aggregate, NULL until ``min_periods`` values are present."""
    x = col(x)
    frame = w.rowsBetween(-(n - 1), 0)
    enough = F.count(x).over(frame) >= F.lit(n if min_periods is None else min_periods)
    return F.when(enough, agg(x).over(frame))


def running(agg: Callable[[Column], Column], x: str | Column, w: WindowSpec) -> Column:
    """Aggregate from the first row of the partition to the current one."""
    return agg(col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def linspace_edges(start: Column | float, stop: Column, k: int) -> Column:
    """``k + 1`` integer edges between start and stop, truncated toward zero.

    The step is formed in double precision and the last edge is exactly
    ``stop``, which is how evenly spaced positions are usually generated.
    """
    start = F.lit(start) if not isinstance(start, Column) else start
    start, stop = start.cast("double"), stop.cast("double")
    step = (stop - start) / F.lit(float(k))
    inner = [(F.lit(float(i)) * step + start).cast("int") for i in range(k)]
    return F.array(*inner, stop.cast("int"))


# ------------------------------------------------- exponential smoothing


@dataclass(frozen=True)
class Smooth:
    """One recursive smoother.

    ``ema``    span ``n``: seeded with the first value, alpha = 2 / (n + 1),
               shown from the ``n``-th value on.
    ``wilder`` period ``n``: seeded with the mean of the first ``n`` values,
               alpha = 1 / n, shown from the seed on.
    Values may be missing only before the first one (a warm-up).
    """

    kind: str
    x: str
    n: int

    @property
    def alpha(self) -> float:
        return 2.0 / (self.n + 1) if self.kind == "ema" else 1.0 / self.n


_NEGLIGIBLE = 1e-17  # below half an ulp: what a dropped history may weigh
_MAX_LOG_SCALE = 600.0  # keeps (1 - alpha) ** -block inside a double


def _block_rows(alpha: float) -> int:
    return max(1, math.ceil(math.log(_NEGLIGIBLE) / math.log1p(-alpha)))


def _scan_groups(specs: dict[str, Smooth]) -> list[tuple[int, list[str]]]:
    """Group smoothers that can share one block length without overflow."""
    groups: list[tuple[int, list[str]]] = []
    for name in sorted(specs, key=lambda s: specs[s].alpha):
        rate = -math.log1p(-specs[name].alpha)
        if groups and groups[-1][0] * rate <= _MAX_LOG_SCALE:
            groups[-1][1].append(name)
        else:
            groups.append((_block_rows(specs[name].alpha), [name]))
    return groups


def smooth(
    df: DataFrame,
    specs: dict[str, Smooth],
    keys: Sequence[str] = KEYS,
    order: str = "date",
    age: str | None = None,
) -> DataFrame:
    """Add one column per smoother in ``specs``, in O(rows) and inside the JVM.

    The recursion ``y[t] = (1 - a) * y[t-1] + u[t]`` is linear, so within a
    block of rows it is a running sum of ``u * (1 - a) ** -offset``.  A block
    is long enough that anything older than the previous block weighs less
    than 1e-17; the carry into a block is therefore the previous block's total
    and nothing else.  Rescaling per block keeps the powers inside a double on
    series of any length.

    ``age`` names a column that resumes a series: 0 on the last bar of a stored
    tail, where the column ``c_<smoother>`` has the value reached there,
    negative before it, positive on the bars that follow.  Where it is null the
    series starts from its first bar.  Values before the stored one are not
    given.
    """
    trivial = [s for s in specs if specs[s].alpha >= 1.0]
    if trivial:
        df = df.withColumns({s: F.col(specs[s].x) for s in trivial})
        specs = {s: v for s, v in specs.items() if s not in trivial}
    if not specs:
        return df

    w = by_date(*keys, order=order)
    scratch: list[str] = ["__pos"]
    seeds = {"__pos": F.row_number().over(w) - 1}
    for name, spec in specs.items():
        seeds[f"__k_{name}"] = running(F.count, spec.x, w)
        scratch.append(f"__k_{name}")
        if spec.kind == "wilder":
            seeds[f"__m_{name}"] = running(F.avg, spec.x, w)
            scratch.append(f"__m_{name}")
    df = df.withColumns(seeds)

    inputs = {}
    for name, spec in specs.items():
        x, k = F.col(spec.x), F.col(f"__k_{name}")
        if spec.kind == "ema":
            inputs[f"__u_{name}"] = F.when(k == 1, x).otherwise(x * spec.alpha)
        else:
            inputs[f"__u_{name}"] = (
                F.when(k < spec.n, None)
                .when(k == spec.n, F.col(f"__m_{name}"))
                .otherwise(x / spec.n)
            )
        if age:
            going_on = F.when(F.col(age) > 0, x * spec.alpha).when(F.col(age) == 0, F.col(f"c_{name.strip('_')}"))
            inputs[f"__u_{name}"] = F.when(F.col(age).isNotNull(), going_on).otherwise(inputs[f"__u_{name}"])
        scratch.append(f"__u_{name}")
    df = df.withColumns(inputs)

    for block, names in _scan_groups(specs):
        df = df.withColumns(
            {
                "__block": F.floor(F.col("__pos") / block),
                "__off": F.col("__pos") % block,
            }
        )
        inner = Window.partitionBy(*keys, "__block").orderBy(order)
        head = inner.rowsBetween(Window.unboundedPreceding, 0)
        whole = inner.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        sums, carries, results = {}, {}, {}
        for name in names:
            keep = F.lit(1.0 - specs[name].alpha)
            u, off = F.col(f"__u_{name}"), F.col("__off")
            sums[f"__s_{name}"] = F.sum(u * F.pow(keep, -off)).over(head)
            sums[f"__t_{name}"] = F.sum(u * F.pow(keep, block - 1 - off)).over(whole)
            carries[f"__c_{name}"] = F.lag(f"__t_{name}", block).over(w)
            level = F.pow(keep, off) * F.coalesce(
                F.col(f"__s_{name}"), F.lit(0.0)
            ) + F.pow(keep, off + 1) * F.coalesce(F.col(f"__c_{name}"), F.lit(0.0))
            shown = F.col(f"__k_{name}") >= specs[name].n
            if age:
                shown = F.coalesce(F.col(age) >= 0, shown)
            results[name] = F.when(shown, level)
            scratch += [f"__s_{name}", f"__t_{name}", f"__c_{name}"]
        df = df.withColumns(sums).withColumns(carries).withColumns(results)
    return df.drop(*scratch, "__block", "__off")


# ------------------------------------------------------- arrival order


ARRIVAL_CHUNK = 1 << 18


def previous_in_arrival(
    df: DataFrame,
    last_known: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    seq: str = "ingest_seq",
    chunk: int = ARRIVAL_CHUNK,
) -> DataFrame:
    """Add ``prev_<c>``: the latest non-missing ``c`` that arrived before this row.

    Raw rows of one symbol are unbounded, so no window spans them all.  Rows
    are cut into chunks of ``chunk`` arrival numbers; windows run inside a
    (symbol, chunk), and one summary row per chunk carries the last value over
    the boundary.  ``seq`` must be unique within a symbol.
    """
    df = df.withColumn("__chunk", F.floor(F.col(seq) / chunk))
    parts = [*keys, "__chunk"]
    before = (
        Window.partitionBy(*parts)
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = df.groupBy(*parts).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__e_{c}")
            for c in last_known
        ]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = edges.select(
        *parts,
        *[
            F.last(f"__e_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}")
            for c in last_known
        ],
    )
    inside = {
        f"prev_{c}": F.last(c, ignorenulls=True).over(before) for c in last_known
    }
    return (
        df.withColumns(inside)
        .join(edges, parts, "left")
        .withColumns(
            {
                f"prev_{c}": F.coalesce(f"prev_{c}", f"__carry_{c}")
                for c in last_known
            }
        )
        .drop("__chunk", *[f"__carry_{c}" for c in last_known])
    )


def first_n(
    df: DataFrame, n: int, keys: Sequence[str], *order: Column | str
) -> DataFrame:
    """First ``n`` rows per key.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per key and task
    before the shuffle, so a key holding most rows stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop(
        "__rn"
    )
