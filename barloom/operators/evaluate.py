"""How good predictions are: error, direction, rank and class metrics.

Rank-based metrics order a group.  With ``symbol`` among the keys a group is
bounded by the calendar and one window does it; keys that pool symbols take
their ranks from sorted ranges of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import mean_when, safe_corr
from barloom.functions.ranks import average_ranks
from barloom.functions.windows import KEYS

REGRESSION = (
    "n", "mae", "rmse", "r2", "directional_accuracy", "hit_rate",
    "information_coefficient", "mean_prediction", "std_prediction",
    "pct_predicted_positive",
)


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank with ties sharing their mean rank, from one window order."""
    w = Window.partitionBy(*keys).orderBy(x)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.rank().over(w) + F.count(F.lit(1)).over(upto)) / 2.0


def with_ranks(df: DataFrame, columns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """``df`` with the mean rank of each named column in its group; see the module for how."""
    if "symbol" in keys:
        return df.withColumns({name: average_rank(x, keys) for name, x in columns.items()})
    for name, x in columns.items():
        df = average_ranks(df, x, keys, name)
    return df


def _scored(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows where both sides are known, as ``__t`` and ``__p``."""
    return df.withColumns({"__t": F.col(truth), "__p": F.col(prediction)}).where(
        F.col("__t").isNotNull() & F.col("__p").isNotNull()
    )


def regression_metrics(
    df: DataFrame,
    truth: str = "target",
    prediction: str = "prediction",
    keys: Sequence[str] = KEYS,
    threshold: float = 0.0,
) -> DataFrame:
    """The ten-field regression record per key."""
    t, p = F.col("__t"), F.col("__p")
    ranked = with_ranks(
        _scored(df, truth, prediction).select(*keys, "__t", "__p"), {"__rt": "__t", "__rp": "__p"}, keys
    )
    n = F.count(F.lit(1))
    sse = F.sum((t - p) * (t - p))
    sst = F.var_pop(t) * n
    r2 = F.when(n < 2, None).when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.try_divide(sse, sst)
    )
    ic = F.when((n >= 3) & (F.stddev_pop(p) > 0), safe_corr("__rt", "__rp"))
    return ranked.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(sse / n).alias("rmse"),
        r2.alias("r2"),
        mean_when(F.when(t != 0, F.signum(t) == F.signum(p))).alias("directional_accuracy"),
        mean_when(F.when(p > threshold, t > 0)).alias("hit_rate"),
        ic.alias("information_coefficient"),
        F.avg(p).alias("mean_prediction"),
        F.stddev_pop(p).alias("std_prediction"),
        mean_when(p > 0).alias("pct_predicted_positive"),
    )


def classification_metrics(
    df: DataFrame,
    truth: str = "target",
    prediction: str = "prediction",
    probability: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Accuracy, precision, recall, F1, base rate and (with scores) exact AUC."""
    base = _scored(df, truth, prediction)
    up, said = F.col("__t") > 0.5, F.col("__p") > 0.5
    n = F.count(F.lit(1))
    tp, fp, fn = F.count_if(up & said), F.count_if(~up & said), F.count_if(up & ~said)
    zero = F.lit(0.0)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), zero)

    out = base.groupBy(*keys).agg(
        n.alias("n"),
        mean_when(up == said).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        mean_when(up).alias("base_rate"),
    )
    if probability is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    return out.join(roc_auc(df, truth, probability, keys), list(keys), "left")


def roc_auc(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Area under the ROC curve from mean ranks; NULL with only one class."""
    ranked = with_ranks(_scored(df, truth, score).select(*keys, "__t", "__p"), {"__r": "__p"}, keys)
    up = F.col("__t") > 0.5
    pos, neg = F.count_if(up).cast("double"), F.count_if(~up).cast("double")
    area = F.sum(F.when(up, F.col("__r"))) - pos * (pos + 1) / 2
    return ranked.groupBy(*keys).agg(F.try_divide(area, pos * neg).alias("roc_auc"))


def confusion(
    df: DataFrame,
    truth: str = "target",
    prediction: str = "prediction",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """2 x 2 counts: two rows per key (actual down, actual up), absent cells 0."""
    up, said = F.col("__t") > 0.5, F.col("__p") > 0.5
    cells = _scored(df, truth, prediction).groupBy(*keys).agg(
        *[
            F.count_if((up == a) & (said == b)).alias(f"c{int(a)}{int(b)}")
            for a in (False, True)
            for b in (False, True)
        ]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("actual"),
                    F.col(f"c{a}0").alias("predicted_down"),
                    F.col(f"c{a}1").alias("predicted_up"),
                )
                for a, name in ((0, "down"), (1, "up"))
            ]
        )
    )
    return cells.select(*keys, rows.alias("r")).select(*keys, "r.*")


def evaluate(df: DataFrame, task: str = "regression", **options) -> DataFrame:
    if task == "classification":
        return classification_metrics(df, **options)
    options.pop("probability", None)
    return regression_metrics(df, **options)


def metrics_frame(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) rows of a metric record, for comparison tables."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "metric", "value"
    )


def sanity_flags(metrics: DataFrame) -> DataFrame:
    """Add ``flags``: which metrics are too good, or too flat, to be real."""
    checks = {
        "r2 above 0.10": F.col("r2") > 0.10,
        "directional accuracy above 0.60": F.col("directional_accuracy") > 0.60,
        "absolute information coefficient above 0.30": F.abs("information_coefficient") > 0.30,
        "constant prediction": F.col("std_prediction") < 1e-9,
    }
    return metrics.withColumn(
        "flags", F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in checks.items()]))
    )
