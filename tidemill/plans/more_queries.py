"""Bars, cleaning, catalogue, backtests and learning over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators, strategies
from ..operators import backtest as T
from ..operators import bars as B
from ..operators import learning as L
from ..operators import quality as Q
from ..operators import selection as S
from ..operators import sweep
from ..sources import bar_cache as cache
from ..sources.shared import shared_path, stored
from . import recursive_sql
from .indicator_sql import SIGNALS, signal_sql
from .sql import BAR, SERIES, TICKS, W, roll, span, stages
from .tick_queries import query, series

PRICES = ("open", "high", "low", "close", "vwap")


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines return one type."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def out(df: DataFrame, *exact: str, numbers: tuple[str, ...] = PRICES) -> DataFrame:
    return text_dates(df.select(*exact, *[F.round(c, 6).alias(c) for c in numbers]))


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


DAY = "CAST(trade_date AS VARCHAR) AS trade_date"
BARS_OUT = f"{DAY}, bar_size, bar_idx, open_time, close_time, volume, tick_count, {r6(*PRICES)}"
BAR_COLUMNS = ("trade_date", "bar_size", "bar_idx", "open_time", "close_time", "volume", "tick_count")


def bars_sql(index: str, sizes: tuple[int, ...], source: str = "t", more: str = "") -> str:
    return f"""WITH {TICKS}{more},
n AS (SELECT t.*, s AS bar_size, {index} AS bar_idx FROM {source} t, (SELECT unnest({list(sizes)}) AS s) z),
b AS (SELECT trade_date, bar_size, bar_idx, {BAR} FROM n GROUP BY trade_date, bar_size, bar_idx)
SELECT {BARS_OUT} FROM b"""


RANKED = ", k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ts, seq) AS rn, sum(volume) OVER (PARTITION BY trade_date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cv FROM {0})"
STATS = """, d AS (SELECT trade_date, median(price) AS day_median FROM t WHERE price > 0 AND volume >= 0 GROUP BY trade_date),
ds AS (SELECT *, avg(day_median) OVER (ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS neighbor_avg FROM d)"""
GOOD = """, g AS (SELECT t.* FROM t JOIN ds USING (trade_date) WHERE price > 0 AND volume >= 0 AND abs(price - day_median) <= 0.15 * day_median
  AND (neighbor_avg IS NULL OR abs(day_median - neighbor_avg) <= 0.15 * neighbor_avg))"""
BY_TICK, BY_VOLUME = "(rn - 1) // s", "CASE WHEN cv > 0 THEN CAST((cv - 1) // s AS BIGINT) ELSE 0 END"


@query("tick_bars", bars_sql(BY_TICK, (20,), "k", RANKED.format("t")))
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(B.tick_bars(B.event_ticks(spark, sf_dir), 20), *BAR_COLUMNS)


@query("tick_bars_sweep", bars_sql(BY_TICK, (20, 50, 100), "k", RANKED.format("t")))
def tick_bars_sweep(spark, sf_dir):
    return out(B.tick_bars(B.event_ticks(spark, sf_dir), [20, 50, 100]), *BAR_COLUMNS)


@query("tick_bars_filtered", bars_sql(BY_TICK, (5,), "k", STATS + GOOD + RANKED.format("g")))
def tick_bars_filtered(spark, sf_dir):
    return out(B.tick_bars(B.median_filter(B.event_ticks(spark, sf_dir)), 5), *BAR_COLUMNS)


@query("tick_bars_static", bars_sql(BY_TICK, (5,), "k", ", g AS (SELECT * FROM t WHERE price BETWEEN 50 AND 2000 AND volume >= 0)" + RANKED.format("g")))
def tick_bars_static(spark, sf_dir):
    return out(B.tick_bars(B.static_filter(B.event_ticks(spark, sf_dir)), 5), *BAR_COLUMNS)


@query("volume_bars", bars_sql(BY_VOLUME, (1000,), "k", RANKED.format("t")))
def volume_bars(spark, sf_dir):
    return out(B.volume_bars(B.event_ticks(spark, sf_dir), 1000), *BAR_COLUMNS)


@query("volume_bars_sweep", bars_sql(BY_VOLUME, (500, 2000), "k", RANKED.format("t")))
def volume_bars_sweep(spark, sf_dir):
    return out(B.volume_bars(B.event_ticks(spark, sf_dir), [500, 2000]), *BAR_COLUMNS)


@query("volume_bars_filtered", bars_sql(BY_VOLUME, (200,), "k", STATS + GOOD + RANKED.format("g")))
def volume_bars_filtered(spark, sf_dir):
    return out(B.volume_bars(B.median_filter(B.event_ticks(spark, sf_dir)), 200), *BAR_COLUMNS)


@query("volume_bars_apart", bars_sql(BY_VOLUME.replace("ELSE 0", "ELSE -1"), (300,), "k", ", g AS (SELECT * FROM t WHERE price BETWEEN 50 AND 2000 AND volume >= 0)" + RANKED.format("g")))
def volume_bars_apart(spark, sf_dir):
    return out(B.volume_bars(B.static_filter(B.event_ticks(spark, sf_dir)), 300, apart=True), *BAR_COLUMNS)


@query("tick_bars_by_symbol", f"WITH {SERIES} SELECT symbol, bar_no, {DAY}, bar_idx, open_time, close_time, volume, tick_count, {r6(*PRICES)} FROM bars")
def tick_bars_by_symbol(spark, sf_dir):
    return out(series(spark, sf_dir), "symbol", "bar_no", "trade_date", "bar_idx", "open_time", "close_time", "volume", "tick_count")


ORDER_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(
    "order_bars",
    f"""WITH n AS (SELECT *, CAST(l_shipdate AS DATE) AS trade_date, (row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_shipdate, {ORDER_SEQ}) - 1) // 10 AS bar_idx FROM lineitem)
SELECT {DAY}, bar_idx, first(l_extendedprice ORDER BY l_shipdate, {ORDER_SEQ}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_shipdate, {ORDER_SEQ}) AS close,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, count(*) AS tick_count FROM n GROUP BY trade_date, bar_idx""",
)
def order_bars(spark, sf_dir):
    return text_dates(B.tick_bars(B.order_ticks(spark, sf_dir), 10, piece=F.struct("ts", F.expr("seq.l_orderkey div 65536"))).select("trade_date", "bar_idx", "open", "high", "low", "close", "volume", "tick_count"))


SIDES = ", sd AS (SELECT *, CAST(coalesce(sign(price - lag(price) OVER (PARTITION BY trade_date ORDER BY ts, seq)), 0) AS INTEGER) AS side FROM t)"


@query(
    "continuous_bars",
    f"""WITH {TICKS}{SIDES}, n AS (SELECT *, (row_number() OVER (ORDER BY ts, seq) - 1) // 30 AS bar_idx FROM sd)
SELECT bar_idx, max(ts) AS datetime, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS tick_count, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  round(sum(price * volume) / greatest(sum(volume), 1), 6) AS vwap, round(sum(CASE WHEN side > 0 THEN volume ELSE 0 END) / greatest(sum(volume), 1), 6) AS buy_ratio,
  round(greatest(0.1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS bar_duration_sec
FROM n GROUP BY bar_idx HAVING count(*) = 30""",
)
def continuous_bars(spark, sf_dir):
    bars = B.continuous_bars(Q.tick_sides(B.event_ticks(spark, sf_dir)), 30)
    return bars.select("bar_idx", "datetime", "volume", "tick_count", "open", "high", "low", "close", *[F.round(c, 6).alias(c) for c in ("vwap", "buy_ratio", "bar_duration_sec")])


@query("day_stats", f"WITH {TICKS}{STATS} SELECT {DAY}, {r6('day_median', 'neighbor_avg')} FROM ds")
def day_stats(spark, sf_dir):
    return out(B.day_stats(B.event_ticks(spark, sf_dir)), "trade_date", numbers=("day_median", "neighbor_avg"))


@query(
    "outlier_count",
    f"""WITH {TICKS}{STATS} SELECT count(*) AS total_ticks, count(*) FILTER (price IS NULL OR price <= 0 OR volume < 0 OR day_median IS NULL OR abs(price - day_median) > 0.15 * day_median
  OR (neighbor_avg IS NOT NULL AND abs(day_median - neighbor_avg) > 0.15 * neighbor_avg)) AS outliers FROM t LEFT JOIN ds USING (trade_date)""",
)
def outlier_count(spark, sf_dir):
    return B.count_outliers(B.event_ticks(spark, sf_dir))


@query(
    "bar_invariants",
    f"""WITH {SERIES} SELECT 20 AS bar_size, count(*) AS bars, CAST(sum(tick_count) AS BIGINT) AS ticks, CAST(sum(volume) AS BIGINT) AS volume,
  count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS bad_range, count(*) FILTER (vwap < low - 1e-4 OR vwap > high + 1e-4) AS bad_vwap, count(*) FILTER (close_time < open_time) AS bad_time FROM bars""",
)
def bar_invariants(spark, sf_dir):
    return B.bar_invariants(series(spark, sf_dir))


@query(
    "extremes",
    f"WITH {SERIES} SELECT symbol, max(high) AS max_high, arg_max(bar_no, (high, -bar_no)) AS max_bar, min(low) AS min_low, arg_min(bar_no, (low, bar_no)) AS min_bar FROM bars GROUP BY symbol",
)
def extremes(spark, sf_dir):
    return B.extremes(series(spark, sf_dir)).select("symbol", "max_high", "max_bar", "min_low", "min_bar")


@query(
    "boundaries",
    f"""WITH {SERIES}, y AS (SELECT symbol, count(DISTINCT trade_date) AS days, min(trade_date) AS first_day FROM bars GROUP BY symbol),
p AS (SELECT symbol, bar_no, days, first_day, CASE WHEN days <= 10 THEN trade_date ELSE CAST(date_trunc('month', trade_date) AS DATE) END AS period FROM bars JOIN y USING (symbol))
SELECT symbol, CAST(period AS VARCHAR) AS period, min(bar_no) AS bar_no FROM p WHERE days > 10 OR period <> first_day GROUP BY symbol, period""",
)
def boundaries(spark, sf_dir):
    return text_dates(B.boundaries(series(spark, sf_dir)).select("symbol", "period", "bar_no"))


@query("tick_sides", f"WITH {TICKS}{SIDES} SELECT seq, side FROM sd")
def tick_sides(spark, sf_dir):
    return Q.tick_sides(B.event_ticks(spark, sf_dir)).select("seq", "side")


CLEAN = ", c AS (SELECT * FROM sd WHERE price > 0 AND price BETWEEN 50 AND 600 QUALIFY row_number() OVER (PARTITION BY trade_date, ts, price, volume ORDER BY seq) = 1)"


@query("clean_ticks", f"WITH {TICKS}{SIDES}{CLEAN} SELECT seq, ts, price, volume, side FROM c")
def clean_ticks(spark, sf_dir):
    return Q.clean(B.event_ticks(spark, sf_dir)).select("seq", "ts", "price", "volume", "side")


@query(
    "halts",
    f"""WITH {TICKS}, h AS (SELECT trade_date, lag(ts) OVER (PARTITION BY trade_date ORDER BY ts, seq) AS halt_from, ts AS halt_to FROM t)
SELECT {DAY}, halt_from, halt_to FROM h WHERE epoch_us(halt_to) - epoch_us(halt_from) > 900000000 AND strftime(halt_from, '%H:%M:%S') BETWEEN '09:00:00' AND '15:30:00'""",
)
def halts(spark, sf_dir):
    return text_dates(Q.halts(B.event_ticks(spark, sf_dir)))


@query(
    "daily_quality",
    f"""WITH {TICKS}{SIDES}{CLEAN},
n AS (SELECT trade_date, count(*) AS ticks, count(*) FILTER (price <= 0) AS not_positive, count(*) FILTER (NOT price BETWEEN 50 AND 600) AS out_of_range, count(*) FILTER (price > 0 AND price BETWEEN 50 AND 600) AS good FROM t GROUP BY trade_date),
k AS (SELECT trade_date, count(*) AS kept FROM c GROUP BY trade_date),
g AS (SELECT trade_date, ts, lag(ts) OVER (PARTITION BY trade_date ORDER BY ts, seq) AS f FROM c),
h AS (SELECT trade_date, count(*) AS halts FROM g WHERE epoch_us(ts) - epoch_us(f) > 900000000 AND strftime(f, '%H:%M:%S') BETWEEN '09:00:00' AND '15:30:00' GROUP BY trade_date)
SELECT {DAY}, ticks, not_positive, out_of_range, coalesce(kept, 0) AS kept, coalesce(halts, 0) AS halts, good - coalesce(kept, 0) AS repeats,
  CASE WHEN coalesce(kept, 0) < 50 THEN 'CORRUPTED' WHEN not_positive > 0 OR out_of_range > 0 THEN 'WARNING' ELSE 'PASSED' END AS status
FROM n LEFT JOIN k USING (trade_date) LEFT JOIN h USING (trade_date)""",
)
def daily_quality(spark, sf_dir):
    return text_dates(Q.daily_quality(B.event_ticks(spark, sf_dir)).select("trade_date", "ticks", "not_positive", "out_of_range", "kept", "halts", "repeats", "status"))


@query("dataset_overview", f"WITH {TICKS} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT trade_date) AS days, count(*) AS ticks FROM t")
def dataset_overview(spark, sf_dir):
    return Q.overview(B.event_ticks(spark, sf_dir))


@query("dataset_by_year", "SELECT strftime(l_shipdate, '%Y') AS period, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, count(*) AS ticks, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem GROUP BY 1")
def dataset_by_year(spark, sf_dir):
    return Q.by_period(B.order_ticks(spark, sf_dir))


@query("available_dates", f"WITH {TICKS} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS period FROM t")
def available_dates(spark, sf_dir):
    return Q.available(B.event_ticks(spark, sf_dir), "yyyy-MM-dd")


@query("available_months", "SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS period FROM lineitem")
def available_months(spark, sf_dir):
    return Q.available(B.order_ticks(spark, sf_dir), "yyyy-MM")


@query("symbols", f"WITH {TICKS} SELECT symbol, count(*) AS ticks FROM t GROUP BY symbol")
def symbols(spark, sf_dir):
    return Q.symbols(B.event_ticks(spark, sf_dir))


@query("suspect_days", f"WITH {TICKS} SELECT {DAY}, max(price) AS max_price, min(price) AS min_price, count(*) AS ticks FROM t GROUP BY trade_date HAVING max(price) > 5000 OR min(price) < 10 OR count(*) < 2000")
def suspect_days(spark, sf_dir):
    return text_dates(Q.suspect_sources(B.event_ticks(spark, sf_dir), "trade_date"))


@query("latest_ticks", f"WITH {TICKS} SELECT seq, ts, price FROM t WHERE price > 50 AND price < 2000 ORDER BY ts DESC, seq DESC LIMIT 15000")
def latest_ticks(spark, sf_dir):
    return Q.latest(B.event_ticks(spark, sf_dir)).select("seq", "ts", "price")


@query("tick_range", f"WITH {TICKS} SELECT seq, ts, symbol, price, volume FROM t WHERE symbol = 'click' AND ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-12 23:59:59'")
def tick_range(spark, sf_dir):
    return B.select_ticks(B.event_ticks(spark, sf_dir), "click", "2024-01-05 00:00:00", "2024-01-12 23:59:59").select("seq", "ts", "symbol", "price", "volume")


@query(
    "close_filter",
    f"WITH {SERIES}, m AS (SELECT symbol, median(close) AS mid, count(*) AS n FROM bars GROUP BY symbol) SELECT symbol, bar_no, close FROM bars JOIN m USING (symbol) WHERE n <= 10 OR (close > 0.2 * mid AND close < 5 * mid)",
)
def close_filter(spark, sf_dir):
    return Q.close_filter(series(spark, sf_dir)).select("symbol", "bar_no", "close")


@query(
    "chart_pack",
    stages(
        f"close - lag(close) OVER {W} AS mv",
        "coalesce(greatest(mv, 0.0), 0.0) AS up, coalesce(greatest(-mv, 0.0), 0.0) AS dn",
        *[f"avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS {n - 1} PRECEDING) AS m{n}" for n in (5, 10, 20, 60, 120)],
        f"coalesce(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING), 0) AS sd, avg(up) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS g, avg(dn) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS l,"
        f" coalesce(sum(close * volume) OVER {W} / nullif(sum(volume) OVER {W}, 0), close) AS cv",
    )
    + "SELECT symbol, bar_no, "
    + ", ".join(f"round(m{n}, 8) AS sma_{n}" for n in (5, 10, 20, 60, 120))
    + ", round(m20 + 2 * sd, 8) AS chart_bb_upper, round(m20 - 2 * sd, 8) AS chart_bb_lower, round(coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50.0), 8) AS chart_rsi, round(cv, 6) AS cum_vwap FROM s8",
)
def chart_pack(spark, sf_dir):
    cols = [*[f"sma_{n}" for n in (5, 10, 20, 60, 120)], "chart_bb_upper", "chart_bb_lower", "chart_rsi"]
    return indicators.chart_pack(series(spark, sf_dir), places=8).select("symbol", "bar_no", *cols, F.round("cum_vwap", 6).alias("cum_vwap"))


# --- backtests ---------------------------------------------------------------------------------------------------

SINGLE = ["EMA_Cross", "RSI", "Bollinger_Bands"]


def signal_rows(spark, sf_dir, names=tuple(SINGLE)):
    rows = strategies.with_signals(series(spark, sf_dir), names)
    return stored(T.long_signals(rows, list(names)), "signals")


def curve_of(spark, sf_dir):
    return stored(T.equity(signal_rows(spark, sf_dir)), "curve")


def _signals_sql(names=tuple(SINGLE)) -> str:
    """WITH ... sg(symbol, strategy, bar_no, open_time, close, volume, signal)."""
    parts, unions = [SERIES], []
    for n, name in enumerate(names):
        last = "bars"
        for i, c in enumerate(SIGNALS[name][0]):
            parts.append(f"q{n}_{i} AS (SELECT *, {c} FROM {last})")
            last = f"q{n}_{i}"
        unions.append(f"SELECT symbol, '{name}' AS strategy, bar_no, open_time, close, volume, {SIGNALS[name][1]} AS signal FROM {last}")
    return "WITH " + ",\n".join([*parts, "sg AS (" + " UNION ALL ".join(unions) + ")"])


P = "(PARTITION BY symbol, strategy ORDER BY bar_no)"
UP = "(PARTITION BY symbol, strategy ORDER BY bar_no ROWS UNBOUNDED PRECEDING)"
CURVE = f""",
e1 AS (SELECT *, CAST(open_time AS DATE) AS day, CASE WHEN strftime(open_time, '%H:%M:%S') >= '15:35:00' OR CAST(open_time AS DATE) IS DISTINCT FROM lead(CAST(open_time AS DATE)) OVER {P} THEN 0 ELSE lag(signal, 1, 0) OVER {P} END AS position FROM sg),
e2 AS (SELECT *, (lag(position, 1, 0) OVER {P} * coalesce(close - lag(close) OVER {P}, 0.0) - abs(position - lag(position, 1, 0) OVER {P}) * 0.05 - abs(position - lag(position, 1, 0) OVER {P}) * close * 0.00003) * 250000.0 AS cash FROM e1),
e3 AS (SELECT *, sum(cash) OVER {UP} AS cum_cash, 100000000.0 + sum(cash) OVER {UP} AS equity FROM e2),
e4 AS (SELECT *, (equity - max(equity) OVER {UP}) / max(equity) OVER {UP} * 100 AS drawdown_pct, cash / coalesce(lag(equity) OVER {P}, 100000000.0) AS bar_ret FROM e3)"""
DEALS = f""",
d1 AS (SELECT *, position IS DISTINCT FROM lag(position) OVER {P} AS is_new, last_value(bar_no) OVER l AS lb, last_value(open_time) OVER l AS lt, last_value(close) OVER l AS lc, last_value(cum_cash) OVER l AS lm FROM e4
  WINDOW l AS (PARTITION BY symbol, strategy ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d2 AS (SELECT *, coalesce(lead(bar_no) OVER {P}, lb) AS eb, coalesce(lead(open_time) OVER {P}, lt) AS et, coalesce(lead(close) OVER {P}, lc) AS ec, coalesce(lead(cum_cash) OVER {P}, lm) AS em FROM d1 WHERE is_new),
tr AS (SELECT symbol, strategy, row_number() OVER {P} AS trade_no, open_time AS entry_time, et AS exit_time, CASE WHEN position > 0 THEN 'LONG' ELSE 'SHORT' END AS side, close AS entry_price, ec AS exit_price,
  round((ec - close) * position, 2) AS pts_pnl, round(em - cum_cash + cash, 2) AS pnl, round((ec - close) * position / nullif(close, 0) * 100, 2) AS ret_pct, eb - bar_no + 1 AS bars_held
  FROM d2 WHERE position <> 0 AND eb > bar_no)"""
CURVE_SQL = _signals_sql() + CURVE


@query("backtest_equity", CURVE_SQL + " SELECT symbol, strategy, bar_no, position, round(cash, 4) AS cash, round(equity, 4) AS equity, round(drawdown_pct, 6) AS drawdown_pct FROM e4")
def backtest_equity(spark, sf_dir):
    curve = T.equity(signal_rows(spark, sf_dir))
    return curve.select("symbol", "strategy", "bar_no", "position", F.round("cash", 4).alias("cash"), F.round("equity", 4).alias("equity"), F.round("drawdown_pct", 6).alias("drawdown_pct"))


@query("backtest_trades", CURVE_SQL + DEALS + " SELECT symbol, strategy, trade_no, entry_time, exit_time, side, entry_price, exit_price, bars_held, round(pnl, 1) AS pnl, round(ret_pct, 1) AS ret_pct FROM tr")
def backtest_trades(spark, sf_dir):
    cols = ["symbol", "strategy", "trade_no", "entry_time", "exit_time", "side", "entry_price", "exit_price", "bars_held"]
    return T.trades(T.equity(signal_rows(spark, sf_dir))).select(*cols, F.round("pnl", 1).alias("pnl"), F.round("ret_pct", 1).alias("ret_pct"))


SUMMARY = """,
a AS (SELECT symbol, strategy, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gw, abs(coalesce(sum(pnl) FILTER (NOT pnl > 0), 0)) AS gl, avg(pnl) FILTER (pnl > 0) AS aw,
  abs(avg(pnl) FILTER (NOT pnl > 0)) AS al, avg(ret_pct) AS avg_r FROM tr GROUP BY symbol, strategy),
y AS (SELECT symbol, strategy, day, sum(bar_ret) AS r FROM e4 GROUP BY ALL),
k AS (SELECT symbol, strategy, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dn FROM y GROUP BY symbol, strategy),
h AS (SELECT symbol, strategy, count(*) AS bars, (arg_max(equity, bar_no) / 100000000.0 - 1) * 100 AS total_return_pct, abs(min(drawdown_pct)) AS mdd_pct, greatest(1, datediff('microsecond', min(open_time), max(open_time)) // 86400000000) AS n FROM e4 GROUP BY symbol, strategy),
sm AS (SELECT symbol, strategy, bars, coalesce(total_trades, 0) AS total_trades, total_return_pct, CASE WHEN 1 + total_return_pct / 100 > 0 THEN (pow(1 + total_return_pct / 100, 365.0 / n) - 1) * 100 ELSE total_return_pct END AS annual_return_pct, mdd_pct,
  coalesce(wins / total_trades * 100, 0) AS win_rate, CASE WHEN gl > 0 THEN gw / gl WHEN gw > 0 THEN 999.0 ELSE 0.0 END AS profit_factor, coalesce(coalesce(aw, 0) / nullif(al, 0), 0) AS payoff_ratio, coalesce(avg_r, 0) AS avg_trade_pct,
  coalesce(sd * sqrt(252) * 100, 0) AS annual_vol_pct, coalesce(m * 252 / (nullif(sd, 0) * sqrt(252)), 0) AS sharpe, coalesce(m * 252 / (nullif(dn, 0) * sqrt(252)), 0) AS sortino
  FROM h LEFT JOIN a USING (symbol, strategy) JOIN k USING (symbol, strategy))"""
FIGURES = ("total_return_pct", "mdd_pct", "win_rate", "profit_factor", "payoff_ratio", "annual_vol_pct", "sharpe", "sortino", "annual_return_pct", "avg_trade_pct")


def summary_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("symbol", "strategy", "bars", "total_trades", *more, *[F.round(c, 4).alias(c) for c in FIGURES])


SUMMARY_OUT = "symbol, strategy, bars, total_trades, " + ", ".join(f"round({c}, 4) AS {c}" for c in FIGURES)


@query("backtest_summary", CURVE_SQL + DEALS + SUMMARY + f" SELECT {SUMMARY_OUT} FROM sm")
def backtest_summary(spark, sf_dir):
    return summary_out(T.summary(curve_of(spark, sf_dir)))


@query(
    "backtest_asked",
    _signals_sql() + ", st AS (SELECT * FROM sg WHERE open_time >= (SELECT date_trunc('hour', max(ts)) FROM t))" + CURVE.replace("FROM sg)", "FROM st)") + DEALS + SUMMARY
    + " SELECT symbol, strategy, coalesce(bars, 0) AS bars, coalesce(total_trades, 0) AS total_trades, " + ", ".join(f"round(coalesce({c}, 0), 4) AS {c}" for c in FIGURES)
    + " FROM (SELECT DISTINCT symbol, strategy FROM sg) LEFT JOIN sm USING (symbol, strategy)",
)
def backtest_asked(spark, sf_dir):
    """The backtest of the last hour for every series, also for those that have no bars in it."""
    rows = signal_rows(spark, sf_dir)
    last = B.event_ticks(spark, sf_dir).agg(F.max("ts")).first()[0]  # null without ticks
    hour = F.lit(last and last.strftime("%Y-%m-%d %H:00:00")).cast("timestamp_ntz")
    curve = stored(T.equity(rows.where(F.col("open_time") >= hour)), "curve")
    return summary_out(T.asked_series(T.summary(curve), rows.select("symbol", "strategy")))


@query("rank_matrix", CURVE_SQL + DEALS + SUMMARY + " SELECT symbol, strategy, row_number() OVER (ORDER BY sharpe DESC, total_return_pct DESC, symbol, strategy) AS place FROM sm")
def rank_matrix(spark, sf_dir):
    return T.rank_matrix(T.summary(curve_of(spark, sf_dir))).select("symbol", "strategy", F.col("place").cast("bigint").alias("place"))


@query("best_strategies", CURVE_SQL + DEALS + SUMMARY + " SELECT symbol, strategy, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY total_return_pct DESC, sharpe DESC, strategy) AS place FROM sm) WHERE place <= 2")
def best_strategies(spark, sf_dir):
    return T.best(T.summary(curve_of(spark, sf_dir)), 2, "total_return_pct", "sharpe").select("symbol", "strategy", F.col("place").cast("bigint").alias("place"))


def _breakdown_sql(pattern: str) -> str:
    return CURVE_SQL + DEALS + f""",
m AS (SELECT *, strftime(open_time, '{pattern}') AS period, (equity - max(equity) OVER p) / max(equity) OVER p * 100 AS dd FROM e4 WINDOW p AS (PARTITION BY symbol, strategy, strftime(open_time, '{pattern}') ORDER BY bar_no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT symbol, strategy, period, sum(cash) AS net_pnl, abs(min(dd)) AS mdd_pct FROM m GROUP BY ALL),
x AS (SELECT symbol, strategy, strftime(entry_time, '{pattern}') AS period, count(*) AS trades FROM tr GROUP BY ALL)
SELECT symbol, strategy, period, round(net_pnl / 1000000.0, 2) AS return_pct, round(mdd_pct, 2) AS mdd_pct, coalesce(trades, 0) AS trades FROM g LEFT JOIN x USING (symbol, strategy, period)"""


@query("breakdown_month", _breakdown_sql("%Y-%m"))
def breakdown_month(spark, sf_dir):
    return T.breakdown(curve_of(spark, sf_dir), "yyyy-MM").select("symbol", "strategy", "period", "return_pct", "mdd_pct", "trades")


@query("breakdown_year", _breakdown_sql("%Y"))
def breakdown_year(spark, sf_dir):
    return T.breakdown(curve_of(spark, sf_dir), "yyyy").select("symbol", "strategy", "period", "return_pct", "mdd_pct", "trades")


VOLS = tuple(n for n in strategies.VOLATILITY if n != "RVI")


@query("vote_momentum", _signals_sql(tuple(strategies.MOMENTUM)) + " SELECT symbol, bar_no, CAST(CASE WHEN avg(signal) > 0.2 THEN 1 WHEN avg(signal) < -0.2 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM sg GROUP BY symbol, bar_no")
def vote_momentum(spark, sf_dir):
    rows = strategies.with_signals(series(spark, sf_dir), strategies.MOMENTUM)
    return T.ensembles(rows, ["MOMENTUM"]).select("symbol", "bar_no", F.col("MOMENTUM_Ensemble").alias("signal"))


@query("vote_custom", _signals_sql(VOLS) + " SELECT symbol, bar_no, CAST(CASE WHEN avg(signal) > 0.2 THEN 1 WHEN avg(signal) < -0.2 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM sg GROUP BY symbol, bar_no")
def vote_custom(spark, sf_dir):
    rows = strategies.with_signals(series(spark, sf_dir), VOLS)
    return rows.select("symbol", "bar_no", strategies.vote(VOLS).cast("int").alias("signal"))


def _all_signals_sql(names) -> str:
    """The signals of the named strategies, each by its own SQL, as sg(symbol, bar_no, signal)."""
    return "WITH RECURSIVE sg AS (" + " UNION ALL ".join(f"SELECT symbol, bar_no, signal FROM ({sql_of(n)})" for n in names) + ")"


def sql_of(name: str) -> str:
    return signal_sql(name) or recursive_sql.SIGNALS[name]


VOTE = " SELECT symbol, bar_no, CAST(CASE WHEN avg(signal) > 0.2 THEN 1 WHEN avg(signal) < -0.2 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM sg GROUP BY symbol, bar_no"


def _vote_query(category: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = strategies.with_signals(series(spark, sf_dir), strategies.CATEGORIES[category])
        return T.ensembles(rows, [category]).select("symbol", "bar_no", F.col(f"{category}_Ensemble").alias("signal"))

    return run


for _c in ("TREND", "VOLATILITY", "CONTRARIAN", "ALL"):
    query(f"vote_{_c.lower()}", _all_signals_sql(strategies.CATEGORIES[_c]) + VOTE)(_vote_query(_c))


SOME = tuple(strategies.MOMENTUM[:7])
BEST = """,
r AS (SELECT symbol, strategy, row_number() OVER (PARTITION BY symbol ORDER BY total_return_pct DESC, sharpe DESC, strategy) AS p, row_number() OVER (PARTITION BY symbol ORDER BY win_rate DESC, total_return_pct DESC, strategy) AS q FROM sm),
c AS (SELECT symbol, strategy, e AS ensemble FROM r, (VALUES ('Top3_Ensemble', 3), ('Top5_Ensemble', 5)) v(e, k) WHERE p <= k UNION ALL SELECT symbol, strategy, 'Top3_WinRate_Ensemble' FROM r WHERE q <= 3)
SELECT symbol, ensemble AS strategy, bar_no, CAST(CASE WHEN avg(signal) > 0.2 THEN 1 WHEN avg(signal) < -0.2 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM sg JOIN c USING (symbol, strategy) GROUP BY symbol, ensemble, bar_no"""


@query("vote_best", _signals_sql(SOME) + CURVE + DEALS + SUMMARY + BEST)
def vote_best(spark, sf_dir):
    rows = signal_rows(spark, sf_dir, SOME)
    return T.top_votes(rows, stored(T.summary(T.equity(rows)), "summaries")).select("symbol", "strategy", "bar_no", "signal")


@query("grid_all")
def grid_all(spark, sf_dir):
    """Every strategy, category votes and the votes of the best, on bars of three sizes."""
    bars = B.with_bar_no(B.tick_bars(B.event_ticks(spark, sf_dir), [20, 40, 80], per_symbol=True))
    names = strategies.CATEGORIES["ALL"]
    rows = T.ensembles(strategies.with_signals(bars, names))
    done = T.grid(rows, [*names, *[f"{c}_Ensemble" for c in strategies.CATEGORIES]])
    return done.select("symbol", "bar_size", "strategy", "bars", "total_trades", *[F.round(c, 4).alias(c) for c in FIGURES])


@query("contract_backtest", CURVE_SQL.replace("0.05 -", "0.25 -").replace("250000.0", "20.0").replace("100000000.0", "74074.07407407407").replace("'15:35:00'", "'24'").replace("IS DISTINCT FROM lead(CAST(open_time AS DATE)) OVER " + P, "IS NULL") + " SELECT symbol, strategy, bar_no, position, round(equity, 4) AS equity FROM e4")
def contract_backtest(spark, sf_dir):
    """An NQ contract with 100 million won, positions held overnight."""
    curve = T.equity(signal_rows(spark, sf_dir), T.contract_costs("NQ", 100_000_000.0, flat_at="24H"))
    return curve.select("symbol", "strategy", "bar_no", "position", F.round("equity", 4).alias("equity"))


@query(
    "trade_cost",
    f"WITH {SERIES} SELECT symbol, bar_no, round((open + close) * 0.00003 + 0.1 + 2 * (1.0 / greatest(1.0, volume)) * 0.00001 * open, 8) AS cost FROM bars",
)
def trade_cost(spark, sf_dir):
    return series(spark, sf_dir).select("symbol", "bar_no", F.round(T.trade_cost(F.col("open"), F.col("close"), volume=F.col("volume")), 8).alias("cost"))


RET = f""",
f1 AS (SELECT *, lag(signal, 1, 0) OVER {P} AS held FROM sg),
f2 AS (SELECT *, abs(held - lag(held, 1, 0) OVER {P}) AS turn, coalesce((close - lag(close) OVER {P}) / greatest(lag(close) OVER {P}, 1e-6), 0) * held AS gross FROM f1),
f3 AS (SELECT *, CASE WHEN turn > 0 THEN 2 * close * 0.00003 + 0.1 + 2 * (1.0 / greatest(1.0, volume)) * 0.00001 * close ELSE 0 END AS points FROM f2),
f4 AS (SELECT *, gross - points / greatest(1.0, close) AS net FROM f3),
f5 AS (SELECT *, exp(sum(ln(1 + greatest(net, -0.999999))) OVER {UP}) AS curve FROM f4),
f6 AS (SELECT *, curve / max(curve) OVER {UP} - 1 AS dd FROM f5),
rb AS (SELECT symbol, strategy, count(*) AS bars, (arg_max(curve, bar_no) - 1) * 100 AS return_pct, abs(min(dd) * 100) AS mdd_pct, CASE WHEN stddev_pop(net) > 0 THEN avg(net) / (stddev_pop(net) + 1e-8) * sqrt(count(*)) ELSE 0 END AS sharpe,
  coalesce(count(*) FILTER (net > 0) / nullif(count(*) FILTER (net <> 0), 0) * 100, 0) AS win_rate, greatest(1, count(*) FILTER (turn > 0) // 2) AS trades,
  CASE WHEN avg(net) > -0.99 THEN (pow(1 + avg(net), count(*)) - 1) * 100 ELSE -99.9 END AS annual_return_pct, CASE WHEN count(*) FILTER (net < 0) > 0 THEN coalesce(sum(net) FILTER (net > 0), 0) / greatest(1e-8, abs(sum(net) FILTER (net < 0))) ELSE 1.0 END AS profit_factor,
  avg(net) * avg(close) AS expectancy_pts, sum(points) * 250000.0 AS total_cost FROM f6 GROUP BY symbol, strategy)"""
RETURNS = ("return_pct", "mdd_pct", "sharpe", "win_rate", "annual_return_pct", "profit_factor", "expectancy_pts", "total_cost")


@query("return_backtest", _signals_sql() + RET + " SELECT symbol, strategy, bars, trades, " + ", ".join(f"round({c}, 4) AS {c}" for c in RETURNS) + " FROM rb")
def return_backtest(spark, sf_dir):
    done = T.return_backtest(signal_rows(spark, sf_dir))
    return done.select("symbol", "strategy", "bars", "trades", *[F.round(c, 4).alias(c) for c in RETURNS])


RANKED_RESULTS = RET + """,
m AS (SELECT strategy AS model, avg(sharpe) AS sharpe, avg(mdd_pct) AS mdd_pct, avg(win_rate) AS win_rate, avg(return_pct) AS return_pct, CAST(sum(trades) AS BIGINT) AS trades FROM rb GROUP BY strategy),
k AS (SELECT *, sharpe > 5.0 OR trades < 10 AS overfitting, row_number() OVER (ORDER BY sharpe DESC, model) AS place FROM m)"""


def ranked_results(spark, sf_dir):
    done = T.return_backtest(signal_rows(spark, sf_dir)).withColumnRenamed("strategy", "model")
    return S.comparison(S.fold_means(done, "model"), "model")


@query("result_summary", _signals_sql() + RANKED_RESULTS + " SELECT model, place, overfitting, trades, round(sharpe, 4) AS sharpe, round(mdd_pct, 4) AS mdd_pct, round(win_rate, 4) AS win_rate, round(return_pct, 4) AS return_pct FROM k")
def result_summary(spark, sf_dir):
    """Strategies as models, symbols as folds."""
    return ranked_results(spark, sf_dir).select("model", "place", "overfitting", "trades", *[F.round(c, 4).alias(c) for c in S.MEANS])


@query("chosen_result", _signals_sql() + RANKED_RESULTS + " SELECT model, place, trades >= 30 AND mdd_pct <= 60 AND NOT overfitting AS candidate FROM k ORDER BY candidate DESC, place LIMIT 1")
def chosen_result(spark, sf_dir):
    return S.chosen(ranked_results(spark, sf_dir), 30, 60.0).select("model", "place", "candidate")


@query("bar_cache", bars_sql(BY_TICK, (50,), "k", RANKED.format("t")).replace(DAY, f"'ALL' AS symbol, {DAY}", 1))
def bar_cache(spark, sf_dir):
    """Bars of two sizes written to the cache and those of one read back."""
    path, ticks = shared_path(spark, "bar-cache"), B.event_ticks(spark, sf_dir)
    for size in (20, 50):
        cache.write(B.tick_bars(ticks, size).withColumn("symbol", F.lit("ALL")), path, cache.Key("tick", size))
    return out(cache.read(spark, path, cache.Key("tick", 50)), "symbol", *BAR_COLUMNS)


CACHED = """, kinds(kind, is_volume) AS (VALUES ('tick', false), ('volume', true)),
o AS (SELECT *, row_number() OVER d AS rn, sum(volume) OVER d AS cum FROM t WINDOW d AS (PARTITION BY trade_date ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT kind, trade_date, CASE WHEN is_volume THEN CAST(greatest(cum - 1, 0) // 40 AS BIGINT) ELSE (rn - 1) // 40 END AS bar_idx, count(*) AS n, sum(volume) AS v FROM o, kinds GROUP BY ALL)"""


@query(
    "bar_cache_refresh",
    f"WITH {TICKS} {CACHED} SELECT kind, CAST(trade_date AS VARCHAR) AS day, count(*) AS bars, CAST(sum(n) AS BIGINT) AS ticks, CAST(sum(v) AS BIGINT) AS volume,"
    " CASE WHEN trade_date = (SELECT min(trade_date) FROM t) OR trade_date = (SELECT max(trade_date) FROM t) THEN 'made' ELSE 'kept' END AS action FROM b GROUP BY kind, trade_date",
)
def bar_cache_refresh(spark, sf_dir):
    """Tick and volume bars of one size side by side, cached while the first day lacks its odd ticks and the last one all,
    then brought up to date: which days were made anew, and what the cache has."""
    path, ticks = shared_path(spark, "bar-cache"), B.event_ticks(spark, sf_dir)
    days = ticks.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last")).first()
    early = ticks.where((F.col("trade_date") < days["last"]) & ((F.col("trade_date") > days["first"]) | (F.col("seq") % 2 == 0)))
    parts = []
    for kind, make in (("tick", B.tick_bars), ("volume", B.volume_bars)):
        key, make_bars = cache.Key(kind, 40), lambda rows, make=make: make(rows, 40)
        cache.refresh(early, path, key, make_bars)
        plan = cache.refresh(ticks, path, key, make_bars)
        bars = cache.read(spark, path, key).groupBy(F.col("trade_date").cast("string").alias("day"))
        bars = bars.agg(F.count("*").alias("bars"), F.sum("tick_count").alias("ticks"), F.sum("volume").alias("volume"))
        parts.append(bars.join(plan.select("day", "action"), "day").withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


SWEEP = (
    TICKS
    + """,
sizes AS (SELECT unnest([16, 24, 32, 40, 48, 56, 64, 72, 80]) AS bar_size),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts, seq) AS rn FROM t),
b AS (SELECT symbol || '~' || bar_size AS symbol, trade_date, (rn - 1) // bar_size AS bar_idx, """
    + BAR
    + """ FROM n, sizes GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date, bar_idx) - 1 AS bar_no FROM b)"""
)


def _sweep_sql() -> str:
    base = _signals_sql(("Donchian_Channel",)).replace(SERIES, SWEEP) + RET
    return base + """,
z AS (SELECT CAST(split_part(symbol, '~', 2) AS INTEGER) AS bar_size, strategy AS model, avg(sharpe) AS sharpe, avg(mdd_pct) AS mdd_pct, CAST(sum(trades) AS BIGINT) AS trades FROM rb GROUP BY ALL),
c AS (SELECT bar_size AS best FROM z WHERE bar_size % 16 = 0 ORDER BY sharpe DESC, bar_size LIMIT 1),
y AS (SELECT *, CASE WHEN bar_size % 16 = 0 THEN 1 ELSE 2 END AS stage FROM z, c WHERE bar_size % 16 = 0 OR abs(bar_size - best) <= 16),
k AS (SELECT *, sharpe > 5.0 OR trades < 10 AS overfitting, row_number() OVER (ORDER BY sharpe DESC, bar_size) AS place FROM y)
SELECT bar_size, stage, place, round(sharpe, 4) AS sharpe, trades, row_number() OVER (ORDER BY trades >= 30 AND mdd_pct <= 60 AND NOT overfitting DESC, place) = 1 AS is_chosen FROM k"""


@query("coarse_to_fine", _sweep_sql())
def coarse_to_fine(spark, sf_dir):
    """Sizes 16 to 80 in steps of 16, then every 8 around the best of them."""
    def score(bars: DataFrame) -> DataFrame:
        rows = stored(T.long_signals(strategies.with_signals(bars, ["Donchian_Channel"]), ["Donchian_Channel"]), "signals")
        return T.return_backtest(rows).withColumnRenamed("strategy", "model")

    rows = sweep.coarse_to_fine(B.event_ticks(spark, sf_dir), score, 16, 80, 16, 8, 16, max_mdd_pct=60.0)
    return rows.select("bar_size", "stage", "place", F.round("sharpe", 4).alias("sharpe"), "trades", "is_chosen")


# --- learning ----------------------------------------------------------------------------------------------------


def learning_bars(spark, sf_dir):
    bars = B.continuous_bars(Q.tick_sides(B.event_ticks(spark, sf_dir)), 30)
    return bars.withColumn("symbol", F.lit("ALL")).withColumn("bar_no", F.col("bar_idx"))


LBARS = f"""{TICKS}{SIDES}, n AS (SELECT *, (row_number() OVER (ORDER BY ts, seq) - 1) // 30 AS bar_no FROM sd),
bars AS (SELECT 'ALL' AS symbol, bar_no, max(ts) AS datetime, {BAR.replace('min(ts) AS open_time, max(ts) AS close_time, ', '').replace('CASE WHEN sum(volume) > 0 THEN sum(price * volume) / sum(volume) ELSE last(price ORDER BY ts, seq) END', 'sum(price * volume) / greatest(sum(volume), 1)')},
  sum(CASE WHEN side > 0 THEN volume ELSE 0 END) / greatest(sum(volume), 1) AS buy_ratio, greatest(0.1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS bar_duration_sec FROM n GROUP BY bar_no HAVING count(*) = 30)"""


def lstages(*columns: str) -> str:
    parts, last = [LBARS], "bars"
    for i, c in enumerate(columns, 1):
        parts.append(f"s{i} AS (SELECT *, {c} FROM {last})")
        last = f"s{i}"
    return "WITH " + ",\n".join(parts) + "\n"


FEATURE_STEPS = [
    f"lag(close) OVER {W} AS pc, {span('close', 10)} AS e10, {span('close', 30)} AS e30, {span('close', 12)} AS e12, {span('close', 26)} AS e26, CAST(hour(datetime) * 60 + minute(datetime) - 540 AS BIGINT) AS mn",
    "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr, greatest(coalesce(close - pc, 0), 0) AS up, greatest(coalesce(pc - close, 0), 0) AS dn, e12 - e26 AS line",
    f"{roll('avg', 'tr', 14)} AS atr, {span('line', 9)} AS sgn, {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS s20, {roll('avg', 'up', 14)} AS g, {roll('avg', 'dn', 14)} AS l, {roll('avg', 'volume', 20)} AS v20, {roll('avg', 'buy_ratio', 5)} AS br5",
    ", ".join(f"(close - lag(close, {n}) OVER {W}) / nullif(lag(close, {n}) OVER {W}, 0) AS ret_{n}" for n in (1, 3, 5, 10)),
    "atr AS atr_14, atr / (close + 1e-6) AS atr_pct, (close - e10) / (atr + 1e-6) AS ema_diff_10, (close - e30) / (atr + 1e-6) AS ema_diff_30, (e10 - e30) / (atr + 1e-6) AS ema_ratio_10_30, 100 - 100 / (1 + g / (l + 1e-8)) AS rsi_14,"
    " (line - sgn) / (atr + 1e-6) AS macd_hist, (close - m20 + 2 * s20) / (4 * s20 + 1e-8) AS bb_pct_b, 4 * s20 / (m20 + 1e-8) AS bb_bandwidth, volume / (v20 + 1e-6) AS vol_surge_ratio, (close - vwap) / (atr + 1e-6) AS vwap_disparity,"
    " br5 AS buy_ratio_ma5, least(greatest(mn, 0), 405) / 405.0 AS session_progress, CASE WHEN mn <= 60 THEN 1.0 ELSE 0.0 END AS is_open_hour, CASE WHEN mn >= 360 THEN 1.0 ELSE 0.0 END AS is_close_hour,"
    " (isodow(datetime) - 1) / 4.0 AS day_of_week, tick_count / bar_duration_sec AS ticks_per_sec, ln(1 + tick_count / bar_duration_sec) AS ticks_per_sec_log",
]


@query(
    "features",
    lstages(*FEATURE_STEPS)
    + ", f AS (SELECT bar_no, datetime, close AS close_raw, "
    + ", ".join(f"lag({c}) OVER {W} AS {c}" for c in L.FEATURES)
    + " FROM s5) SELECT bar_no, datetime, close_raw, "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in L.FEATURES)
    + " FROM f WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in L.FEATURES),
)
def features(spark, sf_dir):
    return L.features(learning_bars(spark, sf_dir)).select("bar_no", "datetime", "close_raw", *[F.round(c, 5).alias(c) for c in L.FEATURES])


@query(
    "triple_barrier",
    lstages(
        f"lag(close) OVER {W} AS pc",
        "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr",
        f"avg(tr) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS atr, list(struct_pack(h := high, l := low, c := close)) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS nx",
        "close + 2 * atr AS top, close - 1.5 * atr AS bot",
        "list_filter(list_transform(nx, lambda b: CASE WHEN b.h >= top THEN 1 WHEN b.l <= bot THEN -1 END), lambda x: x IS NOT NULL) AS hits",
        "CAST(coalesce(hits[1], 0) AS INTEGER) AS label",
        "CASE WHEN label = 1 THEN top WHEN label = -1 THEN bot WHEN len(nx) > 0 THEN nx[len(nx)].c ELSE close END AS ex",
    )
    + "SELECT bar_no, label, round(coalesce((ex - close) / nullif(close, 0), 0), 6) AS ret FROM s7",
)
def triple_barrier(spark, sf_dir):
    return L.triple_barrier(learning_bars(spark, sf_dir)).select("bar_no", "label", F.round("ret", 6).alias("ret"))


@query("forward_return", f"WITH {LBARS} SELECT bar_no, round((lead(close, 5) OVER {W} - close) / nullif(close, 0), 6) AS fwd_ret FROM bars")
def forward_return(spark, sf_dir):
    return L.forward_return(learning_bars(spark, sf_dir)).select("bar_no", F.round("fwd_ret", 6).alias("fwd_ret"))


@query(
    "walk_forward",
    f"""WITH {LBARS}, y AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(datetime AS DATE) AS d FROM bars)),
f AS (SELECT d, fold, i - fold * 5 AS o FROM y, (SELECT unnest(range(greatest(0, ((SELECT count(*) FROM y) - 15) // 5 + 1))) AS fold))
SELECT bar_no, CAST(fold AS INTEGER) AS fold, CASE WHEN o BETWEEN 0 AND 9 THEN 'train' ELSE 'test' END AS part FROM bars JOIN f ON CAST(datetime AS DATE) = d WHERE o BETWEEN 0 AND 9 OR o BETWEEN 11 AND 14""",
)
def walk_forward(spark, sf_dir):
    return L.walk_forward(learning_bars(spark, sf_dir), "datetime", 10, 5, 0.2).select("bar_no", "fold", "part")


@query(
    "purged_folds",
    f"""WITH {LBARS}, i AS (SELECT bar_no, row_number() OVER (ORDER BY datetime, bar_no) - 1 AS i, count(*) OVER () AS n FROM bars),
f AS (SELECT *, fold * (n // 4) AS b, CASE WHEN fold < 3 THEN (fold + 1) * (n // 4) ELSE n END AS e, CAST(floor(n * 0.05) AS BIGINT) AS g FROM i, (SELECT unnest([0, 1, 2, 3]) AS fold))
SELECT bar_no, CAST(fold AS INTEGER) AS fold, CASE WHEN i >= b AND i < e THEN 'test' ELSE 'train' END AS part FROM f WHERE (i >= b AND i < e) OR i < b - g OR i >= e + g""",
)
def purged_folds(spark, sf_dir):
    return L.purged_folds(learning_bars(spark, sf_dir), ("datetime", "bar_no"), 4, 0.05).select("bar_no", "fold", "part")


def _psi_sql() -> str:
    cuts = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
    return f"""WITH {TICKS},
x AS (SELECT CASE WHEN trade_date < DATE '2024-01-16' THEN 'e' ELSE 'a' END AS side, unnest(['price', 'volume']) AS feature, unnest([price, CAST(volume AS DOUBLE)]) AS x FROM t),
c AS (SELECT feature, quantile_cont(x, {cuts}) AS cuts FROM x WHERE side = 'e' GROUP BY feature),
b AS (SELECT side, feature, len(list_filter(cuts, lambda q: x >= q)) AS bucket, count(*) AS n FROM x JOIN c USING (feature) GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY side, feature) AS share FROM b),
g AS (SELECT feature, unnest(range(10)) AS bucket FROM c),
p AS (SELECT g.feature, greatest(coalesce(e.share, 0), 1e-4) AS e, greatest(coalesce(a.share, 0), 1e-4) AS a FROM g LEFT JOIN s e ON e.side = 'e' AND e.feature = g.feature AND e.bucket = g.bucket LEFT JOIN s a ON a.side = 'a' AND a.feature = g.feature AND a.bucket = g.bucket)
SELECT feature, round(sum((a - e) * ln(a / e)), 6) AS psi FROM p GROUP BY feature"""


@query("psi", _psi_sql())
def psi(spark, sf_dir):
    ticks = B.event_ticks(spark, sf_dir)
    early = F.col("trade_date") < F.lit("2024-01-16").cast("date")
    return L.psi(ticks.where(early), ticks.where(~early), ["price", "volume"]).select("feature", F.round("psi", 6).alias("psi"))


@query("drift", f"WITH r AS ({_psi_sql()}) SELECT round(avg(psi), 5) AS mean_psi, count(*) FILTER (psi >= 0.25) AS drifted, count(*) AS features, avg(psi) >= 0.25 OR count(*) FILTER (psi >= 0.25) > count(*) * 0.3 AS is_drift FROM r")
def drift(spark, sf_dir):
    return L.drift(psi(spark, sf_dir)).select(F.round("mean_psi", 5).alias("mean_psi"), "drifted", "features", "is_drift")


@query("sequences", f"WITH {LBARS}, q AS (SELECT bar_no, list(close) OVER (ORDER BY bar_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS xs FROM bars) SELECT bar_no, round(list_sum(xs), 4) AS total, round(xs[1], 4) AS oldest, 3 AS patches FROM q WHERE len(xs) = 8")
def sequences(spark, sf_dir):
    rows = L.sequences(learning_bars(spark, sf_dir), ["close"], 8)
    xs = F.transform("sequence", lambda v: v[0])
    return rows.select("bar_no", F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(xs[0], 4).alias("oldest"), F.size(L.patches(F.col("sequence"))).alias("patches"))


def labelled_folds(spark: SparkSession, sf_dir: str, folds: bool = True) -> DataFrame:
    """Features and labels of the bars; with ``folds`` a row for each fold that one is in."""
    rows = stored(L.labelled_features(stored(learning_bars(spark, sf_dir), "bars")), "labelled")
    return L.walk_forward(rows, "datetime", 12, 6, 0.0) if folds else rows


def _model_query(model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shape = L.boosting.Shape(rounds=8, depth=3, rate=0.2)
        return L.train_and_predict(labelled_folds(spark, sf_dir), L.FEATURES, model, shape=shape).select("bar_no", "fold", "label", "predicted")

    return run


for _m in ("logistic", "forest", "boosted"):
    query(f"model_{_m}")(_model_query(_m))


@query("search_trials")
def search_trials(spark, sf_dir):
    """Trials of a search of boosted trees on the first fold."""
    rows = labelled_folds(spark, sf_dir).where("fold = 0")
    if not rows.limit(1).count():  # too few days for a fold
        return L.search.as_rows(spark, [])
    _, trials = L.tuned(rows.where("part = 'train'"), rows.where("part = 'test'"), L.FEATURES, space=SEARCHED, trials=6)
    return L.search.as_rows(spark, trials).withColumn("value", F.round("value", 6))


SEARCHED = {"rounds": L.search.Range(2, 6, whole=True), "depth": L.search.Range(1, 3, whole=True), "rate": L.search.Range(0.05, 0.3, log=True), "rows_share": L.search.Range(0.6, 1.0)}
