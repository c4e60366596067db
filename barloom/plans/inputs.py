"""The driver tables as bars, raw bars and momentum predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import StudySpec
from barloom.functions.columns import ratio
from barloom.functions.session import ship, tune
from barloom.functions.windows import by_date, roll
from barloom.operators.target import realised_returns
from barloom.plans.oracle_parts import ABSENT_DAY, ARRIVAL, DAMAGE, REVISED_DAY
from barloom.sources.ticks import bars_from_ticks, event_ticks, trade_ticks

#: The trade dates run from 1995 to 2001; the last year is the test part.
SPEC = StudySpec(train_end="1999-12-31", valid_end="2000-12-31")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(tune(spark)).read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def trade_bars(
    spark: SparkSession, sf: str, symbol: str = "l_returnflag", every: str = "day"
) -> DataFrame:
    ticks = trade_ticks(table(spark, sf, "lineitem"), table(spark, sf, "part"), symbol)
    return bars_from_ticks(ticks, every)


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(event_ticks(table(spark, sf, "events")), "hour")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with every kind of damage the quality checks look for."""
    start = F.lit("1995-01-01").cast("date")
    numbered = trade_bars(spark, sf).withColumn("dayno", F.datediff("date", start))
    damaged = numbered.where(f"NOT ({ABSENT_DAY})").selectExpr(
        "symbol",
        "date",
        "dayno",
        *[f"{e} AS {c}" for c, e in DAMAGE.items()],
        f"CAST({ARRIVAL} AS BIGINT) AS ingest_seq",
    )
    # The revision of a day is a second row of the same generator, so the bars
    # are read once.
    plain = F.struct("close", "ingest_seq")
    revised = F.struct(
        (F.col("close") * 1.01).alias("close"),
        (F.col("dayno") * 4 + 1).cast("bigint").alias("ingest_seq"),
    )
    versions = F.when(F.expr(REVISED_DAY), F.array(plain, revised)).otherwise(F.array(plain))
    return (
        damaged.withColumn("v", F.explode(versions))
        .withColumns({"close": F.col("v.close"), "ingest_seq": F.col("v.ingest_seq")})
        .drop("dayno", "v")
    )


def momentum(spark: SparkSession, sf: str, every: str = "week") -> DataFrame:
    """Bars with realised returns and a momentum prediction: close over its mean."""
    bars = realised_returns(trade_bars(spark, sf, every=every), keys=["symbol"])
    mean = roll(F.avg, "close", 20, by_date("symbol"))
    return bars.withColumn("prediction", ratio("close", mean) - 1)
