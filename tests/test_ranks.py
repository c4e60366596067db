import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import average_ranks, positions, quantiles
from barloom.operators.evaluate import regression_metrics, roc_auc
from barloom.operators.feature_stats import describe_features
from barloom.operators.metrics import performance
from barloom.operators.signals import suggest_threshold


def frame(spark, n=3000, seed=1):
    """One group with most rows, ties in a third of them, small groups, a null group and extreme values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 10 < 7 else rng.choice(["a", "b", None])
        x = 0.5 if rng.random() < 0.33 else rng.gauss(0, 1) * 10.0 ** rng.randrange(-3, 4)
        rows.append((i, g, x))
    rows += [(n, "one", 2.5), (n + 1, "far", -1.7e308), (n + 2, "far", 1.7e308), (n + 3, "far", 5e-324), (n + 4, "none", None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "i long, g string, x double").repartition(7)


def test_positions_number_every_row_of_a_group(spark):
    df = frame(spark)
    got = positions(df, ["g"], ["x", "i"]).collect()
    want = {}
    for r in sorted(got, key=lambda r: (r["x"] is not None, r["x"] or 0, r["i"])):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["place"] == want[r["g"]]
    assert sorted(r["place"] for r in positions(df, [], ["i"]).collect()) == list(range(1, df.count() + 1))
    assert positions(df.limit(0), ["g"], ["x"]).count() == 0
    # the group spans several ranges of the sort
    clashing = df.withColumns({"__place": F.lit(1), "__part": F.lit(2)})
    assert positions(clashing, ["g"], ["x", "i"]).where("place < 1").isEmpty()


def test_average_ranks_equal_the_window(spark):
    df = frame(spark).where("x IS NOT NULL")
    w = Window.partitionBy("g").orderBy("x")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("r", (F.rank().over(w) + F.count(F.lit(1)).over(upto)) / 2.0)
    got = average_ranks(df, "x", ["g"], "r")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_equal_percentile(spark, keys):
    df = frame(spark)
    shares = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    want = df.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q"))
    got = quantiles(df, "x", shares, keys, "q")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pooled_metrics_equal_the_bounded_form(spark):
    df = frame(spark).where("g IS NOT NULL AND g NOT IN ('far', 'none')").withColumns(
        {"target": F.sin("i"), "prediction": F.round(F.col("x"), 1), "up": (F.pmod("i", F.lit(3)) == 0).cast("double"), "symbol": F.col("g"),
         "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("i").cast("int")), "r": F.sin("i") / 50}
    )

    def same(make, bounded, pooled):
        a = make(df, bounded).drop("symbol", "g").toPandas()
        b = make(df, pooled).drop("symbol", "g").toPandas()
        a, b = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
        assert ((a - b).abs().fillna(0) < 1e-9).all().all() and (a.isna() == b.isna()).all().all()

    same(lambda d, k: regression_metrics(d, keys=k), ["symbol"], ["g"])
    same(lambda d, k: roc_auc(d, "up", "prediction", k), ["symbol"], ["g"])
    same(lambda d, k: suggest_threshold(d, 30.0, keys=k), ["symbol"], ["g"])
    same(lambda d, k: performance(d, {"x": "r"}, k).drop("series"), ["symbol"], ["g"])
    same(lambda d, k: describe_features(d, ["x", "r"], k).drop("feature"), ["symbol"], ["g"])
