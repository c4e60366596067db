"""Near-duplicate reports: T-occurrence search over shingles with DivideSkip.

Reports whose sets of word shingles are equal form one class.  Classes that can
have a partner at all, because enough of their shingles occur in another class,
are found with one exchange of packed shingles.  For these, the inverted lists
of a prefix of their rarest shingles, kept apart by bands of size, join all
possible partners into families.  A family is searched in bounded groups:
reports are queries against the inverted lists of their group, and
``divide_skip`` counts occurrences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import (
    any_key, byte_view, narrowed, release_memory, runs_of, slices, small_batches, stored, word_hashes,
)
from barloom.llm.components import components

#: Words of a shingle and the similarity, in percent, at which two reports link.
WORDS, PERCENT = 5, 80

#: Shingles packed by a task before it deals them out, and wanted in one range.
BLOCK, RANGE = 1 << 20, 1 << 22

#: Reports from which a shingle is common, and how many common shingles are known: they
#: go to the end of the order, the commonest last.  It changes costs, never results.
OFTEN, COMMON = 6, 1 << 17

#: Reports and shingles of a group, and reports of a large family that all its groups share.
GROUP, GROUP_SHINGLES, SHARED = 4096, 1 << 21, 32

#: Share of the cost of probing one list to that of merging one entry, and the length from which a list is probed.
DIVIDE, PROBE = 0.1, 1 << 10

_MANY = 0xFFFF


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``k`` are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(runs_of(words, min(k, len(words))))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = byte_view(batch.column("report"))
    for lo, hi in slices(offsets):
        hashes, first = word_hashes(data, offsets[lo : hi + 1], fold_case=True)
        for i in range(lo, hi):
            yield i, shingle_set(hashes[first[i - lo] : first[i - lo + 1]])


def _marks(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = np.add.reduce(s).view(np.int64)
        b = np.add.reduce((s ^ (s >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return int(a), int(b)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *_marks(s)) for _, s in _sets(batch)]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("report_id"), *(pa.array(c, pa.int64()) for c in columns)],
            ["report_id", "n_shingles", "mark", "mark2"],
        )


def _packer(ranges: int):
    """Deals out shingles as packed arrays, a row for each range of a block.

    A shingle that several classes of a block have goes once, with no owner; the
    block itself counts it for them.
    """
    schema = pa.schema(
        [("block", pa.int64()), ("range", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()),
         ("classes", pa.binary())]
    )

    def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        marks = np.fromiter(sets, np.int64, len(sets))
        lengths = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        sets.clear()  # memory: what is done in place here would else stand beside copies
        # 48 bits of each shingle stand for it here; one plain sort orders both
        tokens &= ~np.uint64(_MANY)
        tokens |= np.repeat(np.arange(len(marks), dtype=np.uint64), lengths)
        tokens.sort()
        owner = (tokens & np.uint64(_MANY)).astype(np.uint16)
        tokens >>= np.uint64(16)
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(head, len(tokens)))
        local = np.bincount(owner[np.repeat(count > 1, count)], minlength=len(marks))
        owner = np.where(count > 1, np.uint16(_MANY), owner[head])
        tokens = tokens[head]
        del lengths, head, count
        place = (tokens >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rows: list[tuple] = []
        for lo, hi in zip(cuts, [*cuts[1:], len(place)]):
            own = owner[lo:hi]
            used, index = np.unique(own, return_inverse=True)
            names = np.where(used == _MANY, 0, marks[np.minimum(used, len(marks) - 1)])
            index = np.where(own == _MANY, _MANY, index)
            rows.append((
                int(marks[0]), int(place[lo]), tokens[lo:hi].astype("<u4").tobytes(), index.astype("<u2").tobytes(),
                names.astype("<i8").tobytes(),
            ))
        some = np.flatnonzero(local)
        # what a block has counted itself: one row, dealt out by a number of its own
        rows.append((
            int(marks[0]), -1 - int(marks[0]) % ranges, b"", local[some].astype("<i8").tobytes(), marks[some].astype("<i8").tobytes()
        ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, s in _sets(batch):
                if not len(s) or (mark := _marks(s)[0]) in sets:
                    continue
                sets[mark] = s
                held += len(s)
                if held >= BLOCK or len(sets) >= _MANY - 1:
                    yield flush(sets)
                    held = 0
        if sets:
            yield flush(sets)

    return pack


def _views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """The packed numbers of each row of a binary column, without a copy."""
    raw = (x.as_buffer() for x in column)
    return [np.frombuffer(x, kind) if x.size else np.zeros(0, kind) for x in raw]


def _count_shared(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block: how many shingles of its classes, in one range, another class has too."""
    release_memory()
    classes = _views(rows.column("classes"), "<i8")
    if key[0].as_py() < 0:
        out = list(zip(classes, _views(rows.column("owners"), "<i8")))
    else:
        tokens = _views(rows.column("tokens"), "<u4")
        sizes = [len(x) for x in tokens]
        tokens = np.concatenate(tokens)
        marks, number = np.unique(np.concatenate(classes), return_inverse=True)
        owner = np.empty(len(tokens), np.int32)
        at = lo = 0
        for index, names in zip(_views(rows.column("owners"), "<u2"), classes):
            many = index == _MANY
            of_row = owner[lo : lo + len(index)]
            of_row[:] = number[at : at + len(names)][np.where(many, 0, index)]
            of_row[many] = len(marks)
            at += len(names)
            lo += len(index)
        shared = np.zeros(len(tokens), bool)
        eighths = (tokens >> np.uint32(29)).astype(np.uint8)
        for eighth in range(8):  # a part at a time keeps the working arrays small
            use = np.flatnonzero(eighths == eighth)
            if not len(use):
                continue
            entries = tokens[use].astype(np.uint64) << np.uint64(32) | np.arange(len(use), dtype=np.uint64)
            entries.sort()
            back = use[(entries & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            head = np.flatnonzero(np.concatenate([[True], (entries[1:] ^ entries[:-1]) >> np.uint64(32) > 0]))
            ordered = owner[back]
            several = np.minimum.reduceat(ordered, head) != np.maximum.reduceat(ordered, head)
            shared[back] = np.repeat(several, np.diff(np.append(head, len(entries))))
        shared &= owner < len(marks)
        out, at = [], 0
        for n in sizes:
            number, count = np.unique(owner[at : at + n][shared[at : at + n]], return_counts=True)
            out.append((marks[number], count))
            at += n
    return pa.table({
        "block": rows.column("block"),
        "marks": pa.array([m.astype("<i8").tobytes() for m, _ in out], pa.binary()),
        "counts": pa.array([c.astype("<i8").tobytes() for _, c in out], pa.binary()),
    })


def _sum_blocks(rows: pa.Table) -> pa.Table:
    release_memory()
    marks = np.concatenate(_views(rows.column("marks"), "<i8"))
    counts = np.concatenate(_views(rows.column("counts"), "<i8"))
    distinct, at = np.unique(marks, return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    return pa.table({"mark": pa.array(distinct, pa.int64()), "shared": pa.array(total, pa.int64())})


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed sets of class representatives."""
    for batch in batches:
        wanted = batch.column("mark").to_pylist()
        ids = batch.column("report_id").to_pylist()
        rows = [(ids[i], len(s), s.tobytes()) for i, s in _sets(batch) if _marks(s)[0] == wanted[i]]
        for at in range(0, len(rows), 1000):
            part = list(zip(*rows[at : at + 1000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.binary()))],
                ["report_id", "n", "shingles"],
            )


def needed(nx, ny, percent: int = PERCENT):
    """Common shingles that two sets of these sizes need to link."""
    return -(-percent * (nx + ny) // (100 + percent))


class Lists:
    """Inverted lists over the members of a group."""

    def __init__(self, members: list[np.ndarray]):
        self.lengths = np.fromiter(map(len, members), np.int64, len(members))
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens = tokens[head]
        self.ends = np.append(head, len(tokens))
        del tokens  # memory
        self.owner = np.repeat(np.arange(len(members), dtype=np.int32), self.lengths)[order]

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of the query's shingles, the shortest first."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        lo, hi = self.ends[at], self.ends[at + 1]
        order = np.argsort(hi - lo, kind="stable")
        return [self.owner[a:b] for a, b in zip(lo[order].tolist(), hi[order].tolist())]


def divide_skip(query: np.ndarray, lists: Lists, percent: int = PERCENT, skip=None) -> list[tuple[int, int]]:
    """``(member, occurrences)`` of the members that share enough shingles with the query.

    The lists of the query's shingles are divided: the longest are set aside,
    the short ones are merged, and members that can still reach their number
    are looked up in the long ones by binary search.  Members for which the mask
    ``skip`` is true are not looked up.
    """
    own = lists.of(query)
    if not own:
        return []
    need = needed(len(query), lists.lengths, percent)
    # lists of the query's other shingles are empty; they count as merged
    least = int(need.min())
    aside = min(
        least - 1, int(least / (DIVIDE * math.log2(max(len(own[-1]), 2)) + 1)), sum(len(x) >= PROBE for x in own)
    )
    short, long = own[: len(own) - aside], own[len(own) - aside :]
    counts = np.bincount(np.concatenate(short), minlength=len(need)) if short else np.zeros(len(need), np.int64)
    reach = counts + aside >= need
    if skip is not None:
        reach &= ~skip
    members = np.flatnonzero(reach)
    counts, need = counts[members], need[members]
    for left, entries in zip(range(aside - 1, -1, -1), long):
        at = np.minimum(np.searchsorted(entries, members), len(entries) - 1)
        counts += entries[at] == members
        reach = counts + left >= need
        if not reach.all():
            members, counts, need = members[reach], counts[reach], need[reach]
            if not len(members):
                break
    return list(zip(members.tolist(), counts.tolist()))


def _search(rows: pa.Table) -> pa.Table:
    """Links that join the reports of one group, as far as they are not joined yet.

    Without ``asks`` rows the reports ask the lists of one another.  A pair of
    components is settled once one side has asked, so those in the largest
    component need not.
    """
    release_memory()
    order = np.argsort(rows.column("report_id").to_numpy(), kind="stable")
    root, asks = (rows.column(c).to_numpy()[order] for c in ("component", "asks"))
    raw = _views(rows.column("shingles"), "<u8")
    sets = [raw[i] for i in order.tolist()]
    lists = Lists(sets)
    distinct, label = np.unique(root, return_inverse=True)
    kinds = len(distinct)
    every = not asks.any()
    waiting = asks | every
    asked = np.zeros(len(sets), bool)
    largest = np.bincount(label).argmax()
    found = []
    while kinds > 1:
        ready = waiting & (label != largest) if every else waiting
        if not ready.any():
            break
        i = int(ready.argmax())
        waiting[i] = False
        for m, _ in divide_skip(sets[i], lists, skip=asked | (label == label[i])):
            if label[m] != label[i]:
                label[label == label[m]] = label[i]
                kinds -= 1
                found.append((root[i], root[m]))
        asked[i] = True
        largest = np.bincount(label).argmax()
    return pa.table({k: pa.array([x[j] for x in found], pa.int64()) for j, k in enumerate("ab")})


def links(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between components, from groups ``(family, part, other, report_id, component, asks)``."""
    rows = stored(groups).join(held.select("report_id", "shingles"), "report_id")
    return stored(rows.groupBy("family", "part", "other").applyInArrow(_search, "a bigint, b bigint"))


def _size_bands(n: np.ndarray, percent: int) -> np.ndarray:
    """The band of each size; sets that link are in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= n.max(initial=0):
        starts.append(starts[-1] * 100 // percent + 1)
    return np.searchsorted(np.array(starts, np.int64), n, "right") - 1


def _banded(lists: DataFrame) -> DataFrame:
    """Inverted lists by shingle and band of size, so that sizes which never link share none.

    A report stands in the list of its own band and in that of the next; the
    list's key is the ``token``.
    """
    band = F.explode(F.array("band", F.col("band") + 1)).alias("band")
    return lists.withColumnRenamed("token", "shingle").select("report_id", "n", "shingle", band).select(
        F.xxhash64("shingle", "band").alias("token"), "report_id", "n", "shingle"
    )


def _prefixes(order, percent: int, times: int = 1):
    """The rarest shingles of each set: any two sets that link share one of them.

    ``order`` has the common shingles, sorted, from the commonest on in
    ``order.value[1]``; they come last.  ``times`` takes a multiple.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = order.value
        for batch in batches:
            ids = batch.column("report_id").to_pylist()
            tokens, sizes, taken = [], [], []
            for raw in batch.column("shingles").to_pylist():
                s = np.frombuffer(raw, np.int64)
                take = min(len(s), times * (len(s) - -(-percent * len(s) // 100) + 1))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    count = np.where(common[at] == s, often[at], 0)
                    s = s[np.argsort(count, kind="stable")]
                tokens.append(s[:take])
                sizes.append(len(s))
                taken.append(take)
            if tokens:
                sizes = np.array(sizes, np.int64)
                columns = [np.repeat(x, taken) for x in (np.array(ids, np.int64), sizes, _size_bands(sizes, percent))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (np.concatenate(tokens), *columns)],
                    ["token", "report_id", "n", "band"],
                )

    return emit


def _family_edges(lists: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges that join the reports of every list: a report with its smallest head, heads with one another.

    The head of a list is its smallest report.  A report has one edge of its
    own; further heads of its lists are linked to the smallest of them, and near
    copies, which share their lists, repeat these links.
    """
    headed = lists.join(heads, "token").select("report_id", "lo").distinct().withColumn(
        "least", F.min("lo").over(Window.partitionBy("report_id"))
    )
    return headed.select(
        F.explode(F.array(F.struct(F.col("report_id").alias("a"), F.col("least").alias("b")),
                          F.struct(F.col("lo").alias("a"), F.col("least").alias("b")))).alias("e")
    ).select("e.*").where("a <> b").distinct()


def _relabel(belongs: DataFrame, found: DataFrame) -> DataFrame:
    merged = components(found)
    return stored(
        belongs.join(merged, belongs.component == merged.node, "left")
        .withColumn("component", F.coalesce("root", "component"))
        .drop("node", "root")
    )


def _parts(families: DataFrame, size) -> DataFrame:
    """Families dealt over bounded parts; reports with the same smallest shingle stay together."""
    wanted = stored(families.groupBy("family").agg(size.alias("parts")))
    near = stored(
        families.join(wanted, "family").withColumn("near", F.pmod(F.xxhash64("least"), "parts"))
    )
    crowds = stored(near.groupBy("family", "near").agg(size.alias("splits")))
    return stored(
        near.join(crowds, ["family", "near"]).select(
            "family", "report_id", "n", F.col("report_id").alias("component"),
            (F.col("parts") > 1).alias("dealt"),
            F.xxhash64("near", F.pmod(F.xxhash64("report_id"), "splits")).alias("part"),
        )
    )


def _link_families(held: DataFrame, lists: DataFrame, families: DataFrame) -> DataFrame:
    """``(report_id, component)`` of the reports of families ``(report_id, n, least, family)``.

    A family that fits one part is searched there, all pairs at once.  Larger
    ones are dealt over parts that share some reports; what is joined in the
    parts is joined.  Then each report outside the family's largest component
    asks the other parts in which a report of another component has one of its
    rare shingles; of two asking parts, the one asks the other.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES))
    belongs = _parts(families, size)
    common = (
        belongs.where("dealt")
        .groupBy("family", F.pmod(F.xxhash64("report_id", F.lit(1)), F.lit(SHARED)).alias("k"))
        .agg(F.min("report_id").alias("report_id"))
        .join(belongs.where("dealt").select("family", "part").distinct(), "family")
    )
    columns = ["family", "part", F.lit(0).cast("bigint").alias("other"), "report_id"]
    first = belongs.select(*columns).unionByName(common.select(*columns))
    found = links(
        held, first.withColumn("component", F.col("report_id")).withColumn("asks", F.lit(False))
    )
    belongs = _relabel(belongs, found)
    kinds = belongs.where("dealt").groupBy("family", "component").count()
    largest = stored(
        kinds.groupBy("family").agg(
            F.max_by("component", F.struct("count", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds")
        ).where("kinds > 1").drop("kinds")
    )
    if largest.isEmpty():
        return belongs.select("report_id", "component")
    split = stored(
        belongs.join(largest, "family").withColumn("quiet", F.col("component") == F.col("largest"))
    )
    named = stored(lists.select("token", "report_id").join(split, "report_id"))
    holders = stored(
        named.groupBy("token", F.col("part").alias("there")).agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("quiet").alias("has_quiet")
        )
    )
    asking = stored(
        named.where("NOT quiet").join(holders, "token")
        .where("there <> part AND (lo <> component OR hi <> component) AND (there < part OR has_quiet)")
        .select("family", F.col("there").alias("part"), "report_id", "n", "component")
        .distinct()
    )
    askers = stored(
        asking.groupBy("family", "part").agg(size.alias("ask_parts"))
    )
    same = ["family", "part"]
    asks = asking.join(askers, same).select(
        *same, F.pmod(F.xxhash64("report_id", F.lit(2)), "ask_parts").alias("other"),
        "report_id", "component", F.lit(True).alias("asks"),
    )
    asked = split.join(askers, same).select(
        *same, F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("other"),
        "report_id", "component", F.lit(False).alias("asks"),
    )
    return _relabel(belongs, links(held, asks.unionByName(asked))).select("report_id", "component")


@any_key("report_id", "component_id")
@small_batches
def near_duplicates(reports: DataFrame) -> DataFrame:
    """Components of reports ``(report_id, report)`` linked by shared five-word shingles.

    Two reports link when their common shingles are at least ``PERCENT`` of all
    their shingles.  Words are runs without blanks, A-Z as a-z; fewer than five
    words count as one shingle.  Returns per input row ``report_id, n_shingles,
    component_id`` (the smallest id reachable over links, its own included).

    * Null, empty and blank texts have no shingle and are their own component.
    * Repeated rows and equal sets are one class; a class is searched once, so
      a group of copies costs no pairs.
    * Shingles are 64-bit hashes.  Ids should be unique: of rows that repeat an
      id, each text is searched as such.
    * No list, family or number of partners is cut.  Only pairs that other links
      have joined already are left out.
    """
    spark = reports.sparkSession
    reports = reports.select(F.col("report_id").cast("bigint"), F.col("report").cast("string"))
    sets = stored(
        reports.mapInArrow(_describe, "report_id bigint, n_shingles bigint, mark bigint, mark2 bigint")
    )
    same = ["n_shingles", "mark", "mark2"]
    classes = stored(sets.where("n_shingles > 0").groupBy(same).agg(F.min("report_id").alias("first_id")))
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(1, -(-total // RANGE))
    shared = (
        reports.mapInArrow(
            _packer(ranges), "block bigint, range bigint, tokens binary, owners binary, classes binary"
        )
        .groupBy("range")
        .applyInArrow(_count_shared, "block bigint, marks binary, counts binary")
        .groupBy("block")
        .applyInArrow(_sum_blocks, "mark bigint, shared bigint")
        .groupBy("mark")
        .agg(F.sum("shared").alias("shared"))
    )
    able = stored(
        classes.join(shared, "mark")
        .where(F.col("shared") * 100 >= F.col("n_shingles") * PERCENT)
        .select(F.col("first_id").alias("report_id"), "mark")
        .distinct()
    )
    candidates = narrowed(reports, able, "report_id").join(able, "report_id")
    held = stored(candidates.mapInArrow(_hold, "report_id bigint, n bigint, shingles binary"))

    lists = "token bigint, report_id bigint, n bigint, band bigint"
    none = np.zeros(0, np.int64)
    often = (
        held.mapInArrow(_prefixes(spark.sparkContext.broadcast((none, none)), PERCENT, times=2), lists)
        .groupBy("token").count().where(F.col("count") >= OFTEN)
        .orderBy(F.desc("count"), "token").limit(COMMON)
    )
    # at most COMMON rows, which only decide about the order of search
    rows = sorted((r[0], r[1]) for r in often.collect())
    order = spark.sparkContext.broadcast(
        (np.array([t for t, _ in rows], np.int64), np.array([n for _, n in rows], np.int64))
    )
    lists = stored(_banded(held.mapInArrow(_prefixes(order, PERCENT), lists)))
    heads = stored(
        lists.groupBy("token").agg(F.min("report_id").alias("lo"), F.max("report_id").alias("hi"))
        .where("lo < hi").select("token", "lo")
    )
    family = components(_family_edges(lists, heads))
    sizes = lists.groupBy("report_id").agg(F.max("n").alias("n"), F.min("shingle").alias("least"))
    families = stored(
        sizes.join(family, sizes.report_id == family.node).select(
            "report_id", "n", "least", F.col("root").alias("family")
        )
    )
    belongs = _link_families(held, lists, families)
    homes = stored(
        classes.join(belongs, classes.first_id == belongs.report_id, "left").select(
            *same, F.coalesce("component", "first_id").alias("component_id")
        )
    )
    alone = sets.where("n_shingles = 0").select("report_id", "n_shingles", F.col("report_id").alias("component_id"))
    return sets.join(homes, same).select("report_id", "n_shingles", "component_id").unionByName(alone)
