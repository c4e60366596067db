import hashlib

from pyspark.sql import functions as F

from barloom.llm import merkle
from barloom.llm.record_queries import ORACLES, op13_merkle_manifest
from tests.frames import to_spark, walk
from tests.oracle import compare, connect


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan_out):
    """The top of a list of digests, and for each the (left, right) texts of its siblings."""
    paths = [[] for _ in nodes]
    of = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for lo in range(0, len(nodes), fan_out):
            run = nodes[lo : lo + fan_out]
            for slot in range(len(run)):
                for k in of[lo + slot]:
                    paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            up.append(digest("".join(run)))
            below.append([k for group in of[lo : lo + fan_out] for k in group])
        nodes, of = up, below
    return nodes[0], paths


def brute(rows, fan_out=16):
    """rows of (symbol, order key, fields)"""
    trees = {}
    for s, o, fields in rows:
        trees.setdefault(s, []).append((o is not None, o, leaf(fields)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        trees[s].sort(key=lambda t: (t[0], t[1] if t[0] else 0, t[2]))
        made[s] = climb([t[2] for t in trees[s]], fan_out)
    root, above = climb([made[s][0] for s in names], fan_out)
    out = []
    for s, over in zip(names, above):
        for t, path in zip(trees[s], made[s][1]):
            proof = digest("".join(a + b for a, b in path + over))
            out.append((s, t[1], t[2], made[s][0], root, proof, len(path + over)))
    return out, root


def shown(found):
    rows = found.select(
        "symbol", "k", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), F.size("path").alias("n"),
        (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"),
    ).collect()
    assert all(r["ok"] for r in rows)
    return sorted((tuple(r)[:7] for r in rows), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), "op13", op13_merkle_manifest, ORACLES["op13_merkle_manifest"], sf) == []


def test_against_brute_force(spark):
    sizes = {None: 3, "": 1, "A": 16, "B": 17, "é": 40, "Z": 1, "hot": 300}
    rows = [(s, k, f"v{k % 7}") for s, n in sizes.items() for k in range(n)]
    rows += [("A", None, None), ("A", None, None), ("A", 3, "v3"), ("B", 5, "")]
    df = spark.createDataFrame(rows, "symbol string, k bigint, value string").repartition(5)
    for fan_out in (2, 3, 16):
        found = merkle.panel_manifest(df, order=["k"], fields=["symbol", "k", "value"], fan_out=fan_out)
        want, _ = brute([(s, k, (s, k, v)) for s, k, v in rows], fan_out)
        assert shown(found) == sorted(want, key=str)


def test_bars_and_tampering(spark):
    panel = to_spark(spark, walk(40, 1, "AAA")).unionByName(to_spark(spark, walk(21, 2, "BBB")))
    found = merkle.panel_manifest(panel)
    assert set(panel.columns) < set(found.columns) and found.count() == 61
    changed = merkle.record_digest([*merkle.BAR_FIELDS[:6], F.col("adj_close") + 1, "volume"])
    folded = found.select(
        (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("kept"),
        (merkle.fold(changed, F.col("path")) == F.col("root")).alias("touched"),
    ).distinct().collect()
    assert [tuple(r) for r in folded] == [(True, False)]


def test_lone_empty_and_clashing(spark):
    schema = "symbol string, k bigint, value string, tree int, at int, n int, record string, place int, root string"
    one = spark.createDataFrame([("A", 1, "x", 1, 2, 3, "r", 4, "mine")], schema)
    row = merkle.panel_manifest(one, order=["k"], fields=["symbol", "k", "value"]).collect()
    assert len(row) == 1 and row[0]["tree"] == 1 and row[0]["record"] == "r"
    assert row[0]["leaf"] == row[0]["subroot"] == row[0]["root"] == leaf(("A", 1, "x")) and row[0]["path"] == []
    assert merkle.panel_manifest(one.limit(0), order=["k"], fields=["symbol", "k", "value"]).count() == 0
