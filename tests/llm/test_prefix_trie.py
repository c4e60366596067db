import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import prefix_trie as pt
from barloom.llm.record_queries import ORACLES, op12_prefix_trie
from tests.oracle import compare, connect

PARTS = "report_id bigint, position int, section string, body string"


def brute(reports):
    """reports: id -> list of (section, body)"""
    members = {}
    for i, parts in reports.items():
        for d in range(len(parts) + 1):
            members.setdefault(tuple(parts[:d]), []).append(i)
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = sum(not any(len(k) == len(b) + 1 and k[: len(b)] == b for k in members) for b in below)
        saved = sum((len(members[b]) - 1) * (len(b[-1][1]) if b else 0) for b in below)
        up = min(members[key[:-1]]) if key else None
        children = sum(len(k) == len(key) + 1 for k in below)
        ends = ",".join(str(i) for i in sorted(i for i in ids if len(reports[i]) == len(key)))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ids), len(key), up, len(ids), children, leaves, saved, sha))
    return sorted(out, key=str)


def got(spark, rows, ids=None, width=pt.WIDTH, extra=""):
    df = spark.createDataFrame(rows, PARTS + extra)
    named = None if ids is None else spark.createDataFrame([(i,) for i in ids], "report_id bigint")
    nodes, ends = pt.prefix_trie(df, named, width)
    digests = pt.ends_digest(ends).withColumnRenamed("node_report_id", "report_id")
    empty = hashlib.sha256(b"").hexdigest()
    rows = nodes.join(digests, ["report_id", "depth"], "left").select(
        "report_id", "depth", "parent_report_id", "n_reports", "n_children", "n_leaves", "saved_chars",
        F.coalesce("ends_sha256", F.lit(empty)),
    ).collect()
    return sorted(map(tuple, rows), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), "op12", op12_prefix_trie, ORACLES["op12_prefix_trie"], sf) == []


@pytest.mark.parametrize("width", [2, 8])
def test_against_brute_force(spark, width, monkeypatch):
    rng = random.Random(width)
    monkeypatch.setattr(pt, "SUPER", 2)
    reports = {i: [(rng.choice("ab"), rng.choice(["x", "yé"])) for _ in range(rng.randrange(6))] for i in range(0, 8000, 200)}
    reports |= {9000 + i: [("hot", "same")] * 3 for i in range(30)}
    reports |= {10: [("a", "x")] * 20, 11: [("a", "x")] * 19 + [("a", "z")], 12: [], 9999: [("a", "x")] * 20}
    rows = [(i, p, s, b) for i, parts in reports.items() for p, (s, b) in enumerate(parts)]
    rng.shuffle(rows)
    assert got(spark, rows, reports, width) == brute(reports)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None, "q"), (1, 5, "a", "long text"), (2, 0, "", "", "q"), (2, 0, "b", "y", "q"), (2, 0, "b", "y", "q"),
            (None, 1, "a", "x", "q")]
    rows = [r if len(r) == 5 else (*r, "q") for r in rows]
    found = got(spark, rows, extra=", node string")
    # report 2 has three parts that tie; the null id is no report
    assert [r[3] for r in found if r[1] == 0] == [2] and max(r[1] for r in found if r[0] == 2) == 3
    assert found == got(spark, rows[::-1], extra=", node string")
    assert got(spark, []) == []
    assert got(spark, [], [7, 3, 3]) == brute({3: [], 7: []})


def test_report_sections_make_parts(spark):
    rows = [("AAA", "dataset", "rows", "10"), ("AAA", "dataset", "name", None), ("AAA", "metrics", "mae", "0.1"),
            ("BBB", "dataset", "rows", "10"), ("BBB", "dataset", "name", None), ("BBB", "metrics", "mae", "0.2")]
    df = spark.createDataFrame(rows, "symbol string, section string, item string, value string")
    parts = pt.report_parts(df)
    ids = parts.withColumn("report_id", F.when(F.col("symbol") == "AAA", 1).otherwise(2).cast("bigint"))
    nodes, ends = pt.prefix_trie(ids)
    shared = nodes.where("n_reports = 2 AND depth = 1").collect()
    assert len(shared) == 1 and shared[0]["saved_chars"] == len("name: n/a\nrows: 10") and shared[0]["n_leaves"] == 2
    assert sorted(map(tuple, ends.collect())) == [(1, 1, 2), (2, 2, 2)]
