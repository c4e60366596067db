import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from barloom.llm import common, jaccard_join
from barloom.llm import components as component_search
from barloom.llm.queries import op5_jaccard_join
from tests.llm.brute import components

SCHEMA = "report_id bigint, report string"


def run(spark, rows, schema=SCHEMA):
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return {r.report_id: (r.n_shingles, r.component_id) for r in out}


def varied(rng, copies=40):
    """Families of reports with growing edits, shared passages, and hot near copies."""
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    rows, n = [], 0
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 12, 40, 150]))
        for c in range(copies if family == 0 else 6):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if family % 3 == 0 and c % 2:
                w = w + passage
            rows.append((n, " ".join(w).title() if c % 3 == 0 else "\t".join(w)))
            n += 1
    return rows


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard_join(spark, sf).collect()}
    assert got == components(rows)


def test_families_equal_brute_force(spark, monkeypatch):
    rows = varied(random.Random(4))
    assert run(spark, rows) == components(rows)
    # small groups: large families are dealt over many, and loose reports ask all of them
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "SHARED", 1)
    assert run(spark, rows) == components(rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "Stop"), (5, "stop"), (6, "a b"), (7, "A  b"), (9, "a b"),
        (8, "x " * 30000), (10, "x x x x x"), (11, "x x x x"),
    ]
    assert run(spark, rows) == components(rows)
    extra = [(i, t, 1.0, "k") for i, t in rows]
    assert run(spark, extra, SCHEMA + ", n double, token string") == components(rows)
    assert run(spark, []) == {}
    twice = jaccard_join.near_duplicates(spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f")], SCHEMA))
    assert [tuple(r) for r in twice.collect()] == [(3, 2, 3), (3, 2, 3)]


def test_divide_skip_counts_like_intersection():
    rng = np.random.default_rng(0)
    query = np.unique(rng.integers(0, 400, 150)).astype(np.uint64)
    members = []
    for k in range(60):
        keep = query[rng.random(len(query)) < 0.6 + 0.4 * rng.random()]
        members.append(np.unique(np.concatenate([keep, rng.integers(1000, 9999, k).astype(np.uint64)])))
    want = {}
    for i, m in enumerate(members):
        common = len(np.intersect1d(query, m))
        if 100 * common >= 80 * (len(query) + len(m) - common):
            want[i] = common
    assert dict(jaccard_join.divide_skip(query, jaccard_join.Lists(members))) == want


def test_long_lists_are_probed_and_masked_members_left_out(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PROBE", 1)
    rng = np.random.default_rng(3)
    members = [np.unique(rng.integers(0, 60, 90)).astype(np.uint64) for _ in range(300)]
    lists, skip = jaccard_join.Lists(members), np.arange(300) % 3 == 0
    for query in members[:20]:
        common = [len(np.intersect1d(query, m)) for m in members]
        want = {
            k: c for k, c in enumerate(common) if 100 * c >= 80 * (len(query) + len(members[k]) - c) and not skip[k]
        }
        assert dict(jaccard_join.divide_skip(query, lists, skip=skip)) == want


def test_a_group_of_near_copies_asks_a_few_times(monkeypatch):
    """Reports of the largest component need not ask; all others do, on the side of those who ask and of all."""
    rng, asked = random.Random(1), []
    base = rng.sample(range(10**6), 200)
    sets = [sorted({*base[: 200 - k % 3], 10**6 + k}) for k in range(400)]  # near copies
    sets += [sorted({*base[:140], *range(2 * 10**6 + 100 * k, 2 * 10**6 + 100 * k + 60)}) for k in range(5)]  # not so near
    sets += [[*sets[400][:-3], 7]]
    plain = jaccard_join.divide_skip
    monkeypatch.setattr(jaccard_join, "divide_skip", lambda q, *a, **b: asked.append(1) or plain(q, *a, **b))
    rows = {
        "report_id": range(len(sets)), "component": range(len(sets)), "asks": [False] * len(sets),
        "shingles": [np.array(s, np.uint64).tobytes() for s in sets],
    }

    def joined():
        root = list(range(len(sets)))
        for a, b in zip(*(jaccard_join._search(pa.table(rows)).column(c).to_pylist() for c in "ab")):
            root = [root[a] if x == root[b] else x for x in root]
        return collections.Counter(root)

    assert sorted(joined().values()) == [1, 1, 1, 1, 2, 400] and len(asked) < 20
    rows["asks"] = [k >= 400 for k in range(len(sets))]
    assert sorted(joined().values()) == [1] * 404 + [2]


def test_bands_part_sizes_that_never_link(spark, monkeypatch):
    """Reports that share a passage but differ much in length form no family; sizes that can link share a list."""
    band = jaccard_join._size_bands(np.arange(1, 4000), 80).tolist()
    for n, b in enumerate(band, 1):
        assert 0 <= band[min(n * 100 // 80, 3999) - 1] - b <= 1
    rng, families = random.Random(8), []
    rows = []
    for _ in range(8):
        passage = [f"w{rng.randrange(10**9)}" for _ in range(30)]
        long = passage + [f"w{rng.randrange(10**9)}" for _ in range(300)]
        for words in (passage, [*passage, "end"], long, [*long, "end"]):
            rows.append((len(rows), " ".join(words)))
    plain = jaccard_join._link_families

    def seen(held, lists, found):
        families.extend(r["family"] for r in found.collect())
        return plain(held, lists, found)

    monkeypatch.setattr(jaccard_join, "_link_families", seen)
    assert run(spark, rows) == components(rows)
    assert sorted(collections.Counter(families).values()) == [2] * 16


def test_join_rows_stay_proportional_to_the_lists(spark, monkeypatch):
    """Edges of a family of near copies, and what contraction joins, per row of the inverted lists."""
    rng = random.Random(9)
    shares = []
    for size in (100, 500, 2500):
        base = rng.choices([f"w{i}" for i in range(3000)], k=60)
        lists = []
        for n in range(size):
            words = list(base)
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(base)
            tokens = sorted({hash(tuple(words[j : j + 5])) % 100003 for j in range(56)})[:12]
            lists += [(t, n, 56) for t in tokens]
        df = spark.createDataFrame(lists, "token bigint, report_id bigint, n bigint")
        heads = df.groupBy("token").agg({"report_id": "min"}).withColumnRenamed("min(report_id)", "lo").join(
            df.groupBy("token").count().where("count > 1").select("token"), "token"
        )
        edges = jaccard_join._family_edges(df, heads).persist()
        joined = []
        plain = component_search.stored

        def counted(frame):
            out = plain(frame)
            if out.columns == ["a", "b"]:
                joined.append(out.count())
            return out

        monkeypatch.setattr(component_search, "stored", counted)
        roots = {r["root"] for r in component_search.components(edges).collect()}
        monkeypatch.setattr(component_search, "stored", plain)
        assert len(roots) == 1
        shares.append(sum(joined) / len(lists))
        edges.unpersist()
    assert max(shares) < 2 and shares[2] < 1.5 * shares[0]


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(2)
    graphs = [[(i, i + 1) for i in range(60)], [(i, 60) for i in range(60)], [], [(3, 3)]]
    graphs += [[(rng.randrange(50), rng.randrange(50)) for _ in range(k)] for k in (10, 40)]
    for edges in graphs:
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        found = component_search.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert {r["node"]: r["root"] for r in found} == {i: find(i) for i in root}


def test_packed_groups_take_a_few_times_their_size():
    """What a task holds to count a range, beside the rows, in bytes a shingle; the counts are those of sets."""
    n, blocks, rng = 1 << 18, 4, np.random.default_rng(5)
    tokens = [np.sort(rng.integers(0, 1 << 19, n).astype("<u4")) * np.uint32(8191) for _ in range(blocks)]
    marks = [np.arange(3 * b, 3 * b + 3, dtype="<i8") for b in range(blocks)]
    owners = [rng.integers(0, 3, n).astype("<u2") for _ in range(blocks)]
    owners[0][:5] = jaccard_join._MANY
    rows = pa.table({
        "block": pa.array(range(blocks), pa.int64()),
        "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
        "owners": pa.array([o.tobytes() for o in owners], pa.binary()),
        "classes": pa.array([m.tobytes() for m in marks], pa.binary()),
    })
    rows = pa.concat_tables([rows.slice(0, 2), rows.slice(2)])  # groups come in batches
    tracemalloc.start()
    out = jaccard_join._count_shared((pa.scalar(1),), rows)
    peak = tracemalloc.get_traced_memory()[1] / (n * blocks)
    tracemalloc.stop()
    assert peak < 20, peak
    holders = collections.defaultdict(set)
    for t, o, m in zip(tokens, owners, marks):
        for token, k in zip(t.tolist(), o.tolist()):
            holders[token].add(-1 if k == jaccard_join._MANY else int(m[k]))
    for t, o, m, got, count in zip(tokens, owners, marks, *(out.column(c).to_pylist() for c in ("marks", "counts"))):
        want = collections.Counter(
            int(m[k]) for token, k in zip(t.tolist(), o.tolist()) if k != jaccard_join._MANY and len(holders[token]) > 1
        )
        assert dict(zip(np.frombuffer(got, "<i8").tolist(), np.frombuffer(count, "<i8").tolist())) == want


def test_workers_get_small_batches_while_it_runs(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(common, "BATCH", 1 << 14)
    plain = jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df: seen.append(spark.conf.get(name)) or plain(df))
    rows = varied(random.Random(7))
    assert run(spark, rows) == components(rows)
    assert set(seen) == {str(1 << 14)} and spark.conf.get(name) == before
