"""Small synthetic panels."""

import numpy as np
import pandas as pd

BARS = (
    "symbol string, date date, open double, high double, low double, close double, "
    "adj_close double, volume double"
)


def walk(n=400, seed=7, symbol="AAA", start="2021-01-04", mu=0.0004, sigma=0.015):
    """Geometric random walk with a varying daily range."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(mu, sigma, n)))
    width = close * rng.uniform(0.005, 0.03, n)
    place = rng.uniform(0.1, 0.9, n)
    low = close - width * place
    return pd.DataFrame(
        {
            "symbol": symbol,
            "date": pd.bdate_range(start, periods=n).date,
            "open": low + width * rng.uniform(0, 1, n),
            "high": low + width,
            "low": low,
            "close": close,
            "adj_close": close,
            "volume": rng.integers(500_000, 2_000_000, n).astype(float),
        }
    )


def linear_bars(n=60, symbol="AAA", start="2024-01-01"):
    close = np.linspace(100, 130, n)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "date": pd.bdate_range(start, periods=n).date,
            "open": close - 0.5,
            "high": close + 1,
            "low": close - 1,
            "close": close,
            "adj_close": close,
            "volume": 1e6,
        }
    )


def to_spark(spark, pdf, schema=BARS, seq=False):
    names = [p.split(" ")[0] for p in schema.split(", ")]
    rows = [
        tuple(None if v is None or v is pd.NaT or v != v else v for v in row)
        for row in pdf[names].itertuples(index=False)
    ]
    if seq:
        schema += ", ingest_seq bigint"
        numbers = pdf["ingest_seq"] if "ingest_seq" in pdf else range(len(pdf))
        rows = [(*r, int(k)) for r, k in zip(rows, numbers)]
    return spark.createDataFrame(rows, schema)


def local(df, *by):
    pdf = df.toPandas()
    return pdf.sort_values(list(by)).reset_index(drop=True) if by else pdf
