import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.asof import asof_join


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_against_a_plain_search(spark, forward, exact):
    rng = random.Random(forward * 2 + exact)
    start = dt.date(2020, 1, 1)

    def rows(n):
        return [
            (rng.choice(["hot", "hot", "hot", "a", None]), start + dt.timedelta(days=rng.randrange(900)) if rng.random() < 0.97 else None, i)
            for i in range(n)
        ]

    lhs, rhs = rows(400), rows(150)
    left = spark.createDataFrame(lhs, "symbol string, date date, i int")
    right = spark.createDataFrame(rhs, "symbol string, date date, v int")
    got = asof_join(left, right, ["symbol"], "date", forward, exact, stretch_days=40).collect()
    assert len(got) == len(lhs)
    for r in got:
        near = [
            (d, v) for s, d, v in rhs
            if s is not None and s == r["symbol"] and d is not None and r["date"] is not None
            and (d == r["date"] and exact or (d > r["date"] if forward else d < r["date"]))
        ]
        if not near:
            assert r["found"] is None
            continue
        day = min(near)[0] if forward else max(near)[0]
        assert tuple(r["found"]) == (day, max(v for d, v in near if d == day))


def test_a_hot_group_is_dealt_over_stretches(spark):
    left = spark.range(3000).selectExpr("'A' AS symbol", "date_add(DATE '1990-01-01', CAST(id AS INT)) AS date")
    right = left.where("day(date) = 1").withColumn("month", F.month("date"))
    out = asof_join(left, right, ["symbol"], "date", stretch_days=30)
    assert out.where("found.month <> month(date)").isEmpty() and out.count() == 3000
    assert asof_join(left.limit(0), right, ["symbol"], "date").count() == 0
    assert asof_join(left, right.limit(0), ["symbol"], "date").where("found IS NOT NULL").isEmpty()
