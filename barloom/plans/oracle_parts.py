"""SQL fragments the reference queries are assembled from.

They state the same results independently, in plain SQL over whole tables, and
are only used to check the DataFrame operators.
"""

from __future__ import annotations

SERIES = "PARTITION BY symbol ORDER BY date"


def num(*names: str, digits: int = 6) -> str:
    """Rounded double output columns; ``+ 0.0`` drops the sign of zero."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def roll(agg: str, x: str, n: int, least: int | None = None, over: str = SERIES) -> str:
    frame = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END"


def running(agg: str, x: str, over: str = SERIES) -> str:
    return f"{agg}({x}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _bars(source: str, bucket: str) -> str:
    return f"""{source},
bars AS (
  SELECT symbol, {bucket} AS date,
         arg_min(px, row(seq, px)) / 1e6 AS open, max(px) / 1e6 AS high, min(px) / 1e6 AS low,
         arg_max(px, row(seq, px)) / 1e6 AS close, arg_max(px, row(seq, px)) / 1e6 AS adj_close,
         sum(vol) AS volume
  FROM ticks GROUP BY 1, 2)"""


def trade_bars(symbol: str = "l_returnflag", every: str = "day") -> str:
    return _bars(
        f"""ticks AS (
  SELECT {symbol} AS symbol, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS seq,
         CAST(round(p_retailprice * (1 - l_discount) * (1 + l_tax) * 1e6) AS BIGINT) AS px,
         l_quantity AS vol
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
        f"CAST(date_trunc('{every}', ts) AS DATE)",
    )


def event_bars() -> str:
    return _bars(
        """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq,
         CAST(round(value * 1e6) AS BIGINT) AS px, 1.0::DOUBLE AS vol
  FROM events)""",
        "date_trunc('hour', ts)",
    )


#: Deterministic damage done to the daily bars for the quality queries.  The
#: expressions are read by both engines; ``dayno`` counts days from 1995-01-01.
DAMAGE = {
    "open": "CASE WHEN dayno % 73 = 5 THEN -open ELSE open END",
    "high": "CASE WHEN dayno % 101 = 1 THEN low ELSE high END",
    "low": "CASE WHEN dayno % 101 = 1 THEN high ELSE low END",
    "close": "CASE WHEN dayno % 97 = 0 OR dayno % 211 < 6 THEN CAST(NULL AS DOUBLE) "
    "ELSE close END",
    "adj_close": "CASE WHEN dayno % 79 = 4 THEN CAST('Infinity' AS DOUBLE) "
    "WHEN dayno % 61 = 8 THEN adj_close * 2 ELSE adj_close END",
    "volume": "CASE WHEN dayno % 89 = 2 THEN -volume WHEN dayno % 71 = 6 THEN CAST(0 AS DOUBLE) "
    "ELSE volume END",
}
ARRIVAL = "CASE WHEN dayno % 503 = 9 THEN dayno * 4 + 20002 ELSE dayno * 4 END"
ABSENT_DAY = "dayno % 67 = 7"
REVISED_DAY = "dayno % 83 = 3"

FIELDS = "open, high, low, close, adj_close, volume"


def raw_bars() -> str:
    damaged = ", ".join(f"{e} AS {c}" for c, e in DAMAGE.items())
    return f"""{trade_bars()},
numbered AS (SELECT *, date - DATE '1995-01-01' AS dayno FROM bars),
damaged AS (
  SELECT symbol, date, dayno, {damaged}, CAST({ARRIVAL} AS BIGINT) AS ingest_seq
  FROM numbered WHERE NOT ({ABSENT_DAY})),
raw AS (
  SELECT symbol, date, {FIELDS}, ingest_seq FROM damaged
  UNION ALL
  SELECT symbol, date, open, high, low, close * 1.01, adj_close, volume, dayno * 4 + 1
  FROM damaged WHERE {REVISED_DAY})"""


def cleaned_bars() -> str:
    prices = ("open", "high", "low", "close", "adj_close")
    cols = (*prices, "volume")
    inf = " + ".join(f"CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END" for c in cols)
    no_inf = ", ".join(
        f"CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN NULL ELSE {c} END AS {c}" for c in cols
    )
    bad = " + ".join(f"CASE WHEN {c} <= 0 THEN 1 ELSE 0 END" for c in prices)
    positive = ", ".join(f"CASE WHEN {c} > 0 THEN {c} END AS {c}" for c in prices)
    gaps = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in prices)
    fill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
        f" AS {c}"
        for c in prices
    )
    some_null = " OR ".join(f"{c} IS NULL" for c in cols)
    outside = " OR ".join(
        f"{c} > high + 1e-6 OR {c} < low - 1e-6" for c in ("open", "close")
    )
    return f"""{raw_bars()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq DESC) AS pick,
         count(*) OVER (PARTITION BY symbol, date) AS copies
  FROM raw),
finite_bars AS (
  SELECT symbol, date, copies, {inf} AS n_infinite, {no_inf} FROM ranked WHERE pick = 1),
positive_bars AS (
  SELECT symbol, date, copies, n_infinite, {bad} AS n_nonpositive,
         CASE WHEN volume < 0 THEN 1 ELSE 0 END AS negative_volume, {positive},
         CASE WHEN volume >= 0 THEN volume END AS volume
  FROM finite_bars),
filled AS (
  SELECT symbol, date, copies, n_infinite, n_nonpositive, negative_volume, {gaps} AS gaps,
         {fill}, volume
  FROM positive_bars),
marked AS (
  SELECT *, gaps - ({gaps}) AS n_filled,
         CASE WHEN {some_null} THEN 'missing'
              WHEN high < low OR {outside} THEN 'impossible' END AS dropped
  FROM filled)"""


def features(bars: str | None = None) -> str:
    """The whole feature matrix; the recursions run row by row in ``rec``."""
    bars = bars or trade_bars()
    k = {n: f"(2::DOUBLE / {n + 1})" for n in (9, 12, 26)}
    e12 = f"r.e12 * (1 - {k[12]}) + b.close * {k[12]}"
    e26 = f"r.e26 * (1 - {k[26]}) + b.close * {k[26]}"
    macd = f"(({e12}) - ({e26}))"

    def wilder(state: str, x: str, seed: str, at: int) -> str:
        return (
            f"CASE WHEN b.rn < {at} THEN NULL WHEN b.rn = {at} THEN b.{seed} "
            f"ELSE r.{state} + (b.{x} - r.{state}) / 14 END"
        )

    sma = ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 50))
    rets = ", ".join(
        f"close / lag(close, {n}) OVER ({SERIES}) - 1 AS ret_{n}d" for n in (5, 10, 20)
    )
    lags = ", ".join(f"lag(ret_1d, {n}) OVER ({SERIES}) AS ret_lag_{n}" for n in range(1, 6))
    vols = ", ".join(
        f"{roll('stddev_samp', 'ret_1d', n)} * sqrt(252) AS vol_{n}" for n in (5, 20, 60)
    )

    def z(x: str) -> str:
        return f"({x} - {roll('avg', x, 20)}) / nullif({roll('stddev_pop', x, 20)}, 0)"

    return f"""{bars},
b0 AS (
  SELECT *, row_number() OVER ({SERIES}) AS rn, lag(close) OVER ({SERIES}) AS pc,
         lag(volume) OVER ({SERIES}) AS pv
  FROM bars),
b1 AS (
  SELECT *, close / pc - 1 AS ret_1d, ln(close / pc) AS log_ret_1d, close * volume AS dollar,
         greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
         CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS flow,
         CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
         CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss
  FROM b0),
b2 AS MATERIALIZED (
  SELECT *, {running('avg', 'gain')} AS mean_gain, {running('avg', 'loss')} AS mean_loss,
         {running('avg', 'tr')} AS mean_tr, {running('sum', 'flow')} AS obv,
         CASE WHEN ret_1d < 0 THEN ret_1d ELSE 0 END AS down
  FROM b1),
rec AS (
  SELECT symbol, rn, close AS e12, close AS e26, NULL::DOUBLE AS ag, NULL::DOUBLE AS al,
         NULL::DOUBLE AS tr_mean, NULL::DOUBLE AS sig
  FROM b2 WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {e12}, {e26},
         {wilder('ag', 'gain', 'mean_gain', 15)}, {wilder('al', 'loss', 'mean_loss', 15)},
         {wilder('tr_mean', 'tr', 'mean_tr', 14)},
         CASE WHEN b.rn < 26 THEN NULL WHEN b.rn = 26 THEN {macd}
              ELSE r.sig * (1 - {k[9]}) + {macd} * {k[9]} END
  FROM rec r JOIN b2 b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
smoothed AS (
  SELECT symbol, rn, CASE WHEN rn >= 12 THEN e12 END AS ema_fast,
         CASE WHEN rn >= 26 THEN e26 END AS ema_slow,
         CASE WHEN rn >= 26 THEN e12 - e26 END AS macd,
         CASE WHEN rn >= 34 THEN sig END AS macd_signal,
         CASE WHEN ag IS NULL THEN NULL WHEN al = 0 AND ag = 0 THEN 50 WHEN al = 0 THEN 100
              ELSE 100 - 100 / (1 + ag / al) END AS rsi,
         tr_mean AS atr
  FROM rec),
w1 AS (
  SELECT b2.*, {sma}, {rets}, {lags}, {vols},
         {roll('stddev_samp', 'down', 20)} * sqrt(252) AS downside_vol_20,
         volume / nullif(pv, 0) - 1 AS volume_change,
         {roll('avg', 'volume', 20)} AS volume_sma, {z('volume')} AS volume_zscore,
         dollar / nullif({roll('avg', 'dollar', 20)}, 0) AS dollar_volume_ratio,
         {z('obv')} AS obv_zscore,
         (high - low) / nullif(close, 0) AS high_low_range,
         (close - low) / nullif(high - low, 0) AS close_position,
         (open - pc) / pc AS gap_open,
         {roll('stddev_pop', 'close', 20)} AS sd_20,
         {roll('max', 'high', 14)} AS top_14, {roll('min', 'low', 14)} AS low_14,
         close / {roll('max', 'close', 252, 60)} - 1 AS dist_from_52w_high,
         close / {roll('min', 'close', 252, 60)} - 1 AS dist_from_52w_low,
         CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week, CAST(month(date) AS DOUBLE) AS month
  FROM b2),
wide AS (
  SELECT w1.*, ema_fast, ema_slow, macd, macd_signal, rsi, atr,
         close / sma_5 AS close_sma_5_ratio, close / sma_10 AS close_sma_10_ratio,
         close / sma_20 AS close_sma_20_ratio, close / sma_50 AS close_sma_50_ratio,
         sma_5 / sma_20 AS sma_5_20_ratio, ema_fast / ema_slow AS ema_12_26_ratio,
         vol_5 / nullif(vol_20, 0) AS vol_ratio_5_20,
         volume / nullif(volume_sma, 0) AS volume_ratio, rsi AS rsi_14,
         macd / close AS macd_norm, macd_signal / close AS macd_signal_norm,
         (macd - macd_signal) / close AS macd_hist_norm,
         sma_20 AS bb_middle, sma_20 + 2 * sd_20 AS bb_upper, sma_20 - 2 * sd_20 AS bb_lower,
         (close - (sma_20 - 2 * sd_20)) / nullif(4 * sd_20, 0) AS bb_pct_b,
         4 * sd_20 / nullif(sma_20, 0) AS bb_bandwidth,
         atr / close AS atr_pct,
         100 * (close - low_14) / nullif(top_14 - low_14, 0) AS stoch_k,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
  FROM w1 JOIN smoothed USING (symbol, rn))"""


def complete(names: list[str], bars: str | None = None) -> str:
    """``feat``: rows of the matrix without any missing feature."""
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"{features(bars)},\nfeat AS MATERIALIZED (SELECT * FROM wide WHERE {known})"


def tall(names: list[str], source: str = "feat", keep: str = "symbol") -> str:
    """``long_feat``: one row per feature value."""
    parts = " UNION ALL ".join(
        f"SELECT {keep}, '{n}' AS feature, {n} AS value FROM {source}" for n in names
    )
    return f"long_feat AS ({parts})"


def dataset(names: list[str], train_end: str, valid_end: str) -> str:
    """``data``: targets on the surviving rows, and the split."""
    return f"""{complete(names)},
ahead AS (
  SELECT *, lead(close) OVER ({SERIES}) / close - 1 AS return_1d_fwd FROM feat),
data AS MATERIALIZED (
  SELECT *, return_1d_fwd AS target,
         CASE WHEN date <= DATE '{train_end}' THEN 'train'
              WHEN date <= DATE '{valid_end}' THEN 'valid' ELSE 'test' END AS split
  FROM ahead WHERE return_1d_fwd IS NOT NULL)"""


def momentum(every: str = "week") -> str:
    """``sig``: returns, the momentum prediction and its signal."""
    return f"""{trade_bars(every=every)},
pred AS (
  SELECT *, coalesce(close / lag(close) OVER ({SERIES}) - 1, 0) AS asset_return,
         close / ({roll('avg', 'close', 20)}) - 1 AS prediction
  FROM bars)"""


def backtest(
    source: str = "pred",
    keys: str = "symbol",
    threshold: str = "0",
    bps: str = "7",
    short: bool = True,
) -> str:
    """``bt``: the per-bar backtest result of ``source`` for every key."""
    over = f"PARTITION BY {keys} ORDER BY date"
    low = f"WHEN prediction < -({threshold}) THEN -1.0::DOUBLE" if short else ""
    return f"""sig AS (
  SELECT *, CASE WHEN prediction > {threshold} THEN 1.0::DOUBLE {low} ELSE 0.0::DOUBLE END AS signal
  FROM {source}),
held AS (
  SELECT *, coalesce(lag(signal, 1) OVER ({over}), 0) AS position,
         coalesce(lag(signal, 2) OVER ({over}), 0) AS before
  FROM sig),
paid AS (
  SELECT *, abs(position - before) AS turnover, abs(position - before) * ({bps}) / 1e4 AS cost,
         position * asset_return AS gross_return,
         position * asset_return - abs(position - before) * ({bps}) / 1e4 AS strategy_return
  FROM held),
grown AS (
  SELECT *, {running('product', '1 + strategy_return', over)} AS equity,
         {running('product', '1 + asset_return', over)} AS benchmark_equity
  FROM paid),
bt AS MATERIALIZED (
  SELECT *, equity / {running('max', 'equity', over)} - 1 AS drawdown FROM grown)"""


def trades(keys: str = "symbol") -> str:
    """``trades``: the round trips of ``bt``."""
    over = f"PARTITION BY {keys} ORDER BY date"
    return f"""steps AS (
  SELECT *, lead(cost) OVER ({over}) AS exit_cost,
         CASE WHEN position <> coalesce(lag(position) OVER ({over}), 0) THEN 1 ELSE 0 END AS fresh
  FROM bt),
runs AS (SELECT *, {running('sum', 'fresh', over)} AS run FROM steps),
trips AS (
  SELECT {keys}, run, min(date) AS entry_date, max(date) AS exit_date,
         CASE WHEN min(position) > 0 THEN 'long' ELSE 'short' END AS direction,
         CAST(count(*) AS INTEGER) AS holding_days, arg_min(close, date) AS entry_price,
         arg_max(close, date) AS exit_price,
         product(1 + position * asset_return) - 1 AS gross_return,
         sum(cost) + coalesce(arg_max(coalesce(exit_cost, 0), date), 0) AS cost
  FROM runs WHERE position <> 0 GROUP BY {keys}, run),
trades AS (
  SELECT *, gross_return - cost AS net_return, gross_return - cost > 0 AS win FROM trips)"""


METRICS = (
    "total_return", "cagr", "avg_daily_return", "annualised_volatility", "sharpe_ratio",
    "sortino_ratio", "max_drawdown", "max_drawdown_days", "calmar_ratio", "win_rate",
    "profit_factor", "var_95", "cvar_95", "n_days",
)


def performance(source: str, keys: str, name: str = "perf", r: str = "r", extra: str = "") -> str:
    """``{name}``: the metric record of column ``r`` for every key."""
    over = f"PARTITION BY {keys} ORDER BY date"
    return f"""{name}_eq AS (
  SELECT *, {running('product', f'1 + {r}', over)} AS eq,
         row_number() OVER ({over}) AS pos,
         quantile_cont({r}, 0.05) OVER (PARTITION BY {keys}) AS var5
  FROM {source}),
{name}_dd AS (
  SELECT *, eq / greatest({running('max', 'eq', over)}, 1) - 1 AS dd FROM {name}_eq),
{name}_run AS (
  SELECT *, pos - coalesce({running('max', 'CASE WHEN dd >= -1e-12 THEN pos END', over)}, 0) AS wet
  FROM {name}_dd),
{name}_agg AS (
  SELECT {keys}, count({r}) AS n_days, product(1 + {r}) AS growth, avg({r}) AS mean,
         stddev_samp({r}) AS sd, stddev_samp(CASE WHEN {r} < 0 THEN {r} END) * sqrt(252) AS down,
         min(dd) AS worst, max(wet) AS wet,
         avg(CASE WHEN {r} > 0 THEN 1.0 WHEN {r} < 0 THEN 0.0 END) AS win_rate,
         coalesce(sum(CASE WHEN {r} > 0 THEN {r} END), 0) AS gains,
         abs(coalesce(sum(CASE WHEN {r} < 0 THEN {r} END), 0)) AS losses,
         min(var5) AS var_95, avg(CASE WHEN {r} <= var5 THEN {r} END) AS cvar_95 {extra}
  FROM {name}_run GROUP BY {keys}),
{name}_cagr AS (
  SELECT *, CASE WHEN n_days < 2 THEN NULL WHEN growth <= 0 THEN -1
                 ELSE pow(growth, 252.0 / n_days) - 1 END AS cagr
  FROM {name}_agg),
{name} AS (
  SELECT *, growth - 1 AS total_return, mean AS avg_daily_return,
         sd * sqrt(252) AS annualised_volatility,
         CASE WHEN sd >= 1e-12 THEN mean / sd * sqrt(252) END AS sharpe_ratio,
         CASE WHEN down >= 1e-12 THEN mean * 252 / down END AS sortino_ratio,
         worst AS max_drawdown, CAST(wet AS BIGINT) AS max_drawdown_days,
         CASE WHEN abs(worst) >= 1e-12 THEN cagr / abs(worst) END AS calmar_ratio,
         CASE WHEN losses > 0 THEN gains / losses
              WHEN gains > 0 THEN 'Infinity'::DOUBLE END AS profit_factor
  FROM {name}_cagr)"""


def score_runs(source: str, keys: str, threshold: str, bps: str) -> str:
    """``runs_scored``: nine summary fields and the benchmark for every key."""
    over = f"PARTITION BY {keys} ORDER BY date"
    extra = (
        ", avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END) AS exposure, "
        "sum(fresh) AS n_trades, sum(cost) AS total_cost"
    )
    return f"""{backtest(source, keys, threshold, bps, short=False)},
entered AS (
  SELECT *, strategy_return AS r,
         CASE WHEN position <> 0 AND position <> coalesce(lag(position) OVER ({over}), 0)
              THEN 1 ELSE 0 END AS fresh
  FROM bt),
{performance('entered', keys, extra=extra)},
hold AS (SELECT {keys}, product(1 + asset_return) - 1 AS buy_and_hold_return FROM bt GROUP BY {keys}),
runs_scored AS (
  SELECT perf.*, buy_and_hold_return, total_return + 1 AS final_equity,
         total_return - buy_and_hold_return AS excess_return,
         total_return > buy_and_hold_return AS beats_buy_and_hold
  FROM perf JOIN hold USING ({keys}))"""


RUN_NUMBERS = (
    "total_return", "cagr", "sharpe_ratio", "max_drawdown", "win_rate", "exposure",
    "total_cost", "final_equity",
)


def regression_record(source: str, keys: str, t: str = "t", p: str = "p") -> str:
    """``reg``: the regression record of ``t`` against ``p``."""
    def mean_rank(x: str) -> str:
        return (
            f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) * 2 "
            f"+ count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
        )

    return f"""known AS (SELECT * FROM {source} WHERE {t} IS NOT NULL AND {p} IS NOT NULL),
ranks AS (SELECT *, {mean_rank(t)} AS rt, {mean_rank(p)} AS rp FROM known),
reg AS (
  SELECT {keys}, count(*) AS n, avg(abs({t} - {p})) AS mae, sqrt(avg(({t} - {p}) ** 2)) AS rmse,
         1 - sum(({t} - {p}) ** 2) / (var_pop({t}) * count(*)) AS r2,
         avg(CASE WHEN {t} <> 0 THEN CASE WHEN sign({t}) = sign({p}) THEN 1.0 ELSE 0.0 END END)
           AS directional_accuracy,
         avg(CASE WHEN {p} > 0 THEN CASE WHEN {t} > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate,
         corr(rt, rp) AS information_coefficient, avg({p}) AS mean_prediction,
         stddev_pop({p}) AS std_prediction,
         avg(CASE WHEN {p} > 0 THEN 1.0 ELSE 0.0 END) AS pct_predicted_positive
  FROM ranks GROUP BY {keys})"""


REG_NUMBERS = (
    "mae", "rmse", "r2", "directional_accuracy", "hit_rate", "information_coefficient",
    "mean_prediction", "std_prediction", "pct_predicted_positive",
)


def ridge(train: str, keys: str, names: list[str], alpha: float) -> str:
    """``coefs``: a ridge fit per key, by Gauss-Jordan elimination over list rows.

    ``train`` has the keys, the features and ``target``.  Inputs are scaled by
    their mean and population deviation in the group.
    """
    n = len(names)
    both = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""packed AS MATERIALIZED (
  SELECT {keys}, row_number() OVER () AS rid, [{', '.join(f'CAST({c} AS DOUBLE)' for c in names)}] AS x,
         target AS y FROM {train}),
long AS MATERIALIZED (
  SELECT {keys}, rid, y, unnest(range(1, {n + 1})) AS i, unnest(x) AS v FROM packed),
scales AS MATERIALIZED (
  SELECT {keys}, i, avg(v) AS mu, avg(y) AS mu_y,
         CASE WHEN sqrt(var_pop(v)) > abs(avg(v)) * 1e-7 THEN sqrt(var_pop(v)) ELSE 1 END AS sd
  FROM long GROUP BY {keys}, i),
z AS MATERIALIZED (
  SELECT {keys}, rid, i, (v - mu) / sd AS z, y - mu_y AS yc FROM long JOIN scales USING ({keys}, i)),
cells AS (
  SELECT {a_keys}, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS c
  FROM z a JOIN z b ON {both} AND a.rid = b.rid GROUP BY {a_keys}, a.i, b.i
  UNION ALL SELECT {keys}, i, {n + 1}, sum(z * yc) FROM z GROUP BY {keys}, i),
matrix AS MATERIALIZED (SELECT {keys}, i, list(c ORDER BY j) AS r FROM cells GROUP BY {keys}, i),
gj AS (
  SELECT {keys}, 0 AS step, list(r ORDER BY i) AS m FROM matrix GROUP BY {keys}
  UNION ALL
  SELECT {keys}, step + 1, list_transform(m, lambda r, i: CASE WHEN i = step + 1
      THEN list_transform(r, lambda v: v / m[step + 1][step + 1])
      ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
  FROM gj WHERE step < {n}),
betas AS MATERIALIZED (
  SELECT {keys}, unnest(range(1, {n + 1})) AS i, unnest(list_transform(m, lambda r: r[{n + 1}])) AS beta
  FROM gj WHERE step = {n}),
coefs AS MATERIALIZED (
  SELECT {keys}, list(beta / sd ORDER BY i) AS coef, list(abs(beta) ORDER BY i) AS weight,
         any_value(mu_y) - sum(mu * beta / sd) AS intercept
  FROM betas JOIN scales USING ({keys}, i) GROUP BY {keys})"""


def fitted(names: list[str]) -> str:
    """The prediction of ``coefs`` for a row with the features."""
    return f"intercept + list_dot_product(coef, [{', '.join(f'CAST({c} AS DOUBLE)' for c in names)}])"


def with_sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
