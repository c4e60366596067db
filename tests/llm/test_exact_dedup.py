import hashlib
import random
import re

import pytest

from barloom.llm import exact_dedup
from barloom.llm.queries import ORACLES, op7_exact_dedup
from tests.oracle import compare, connect

SCHEMA = "report_id bigint, report string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[plain])[1]
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), "op7", op7_exact_dedup, ORACLES["op7_exact_dedup"], sf) == []


@pytest.mark.parametrize("bits", [62, 2])
def test_edges_and_collisions(spark, bits):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "ab"), (5, "a b"), (6, "ba"), (7, "é é"), (8, "éé"), (9, "x" * 50000),
            (10, "x " * 50000), (11, "x" * 49999 + "y")]
    rows += [(100 + i, "".join(rng.choices("ab ", k=rng.randrange(5)))) for i in range(200)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), bits).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_rows_extra_columns_and_empty(spark):
    rows = [(1, "a", 5, "z"), (1, "a", 5, "z"), (2, " a", 5, "z")]
    df = spark.createDataFrame(rows, SCHEMA + ", fingerprint int, chunk string")
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(df).collect())
    assert got == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_compose():
    a, b = b"abc" * 9000, b"xyz" * 20000
    for which in (0, 1):
        left, right = exact_dedup.fingerprint(a)[which], exact_dedup.fingerprint(b)[which]
        assert exact_dedup.combine(left, right, len(b), which) == exact_dedup.fingerprint(a + b)[which]
