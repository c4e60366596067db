"""Panel time-series research on Spark: bars, features, models, backtests.

Every operator takes and returns DataFrames keyed ``(symbol, date)``.
"""
