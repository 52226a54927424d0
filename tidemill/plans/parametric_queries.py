"""Indicators with other spans than the usual ones, as columns and from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parametric
from .indicator_sql import PC, RSI, TR
from .recursive_sql import supertrend_sql
from .sql import ewm, roll, stages
from .tick_queries import query, series


def from_sql(spark, sf_dir: str, columns: str, call: str) -> DataFrame:
    """The table function over the bars, in SQL."""
    parametric.register(spark)
    series(spark, sf_dir).createOrReplaceTempView("tidemill_bars")
    return spark.sql(f"SELECT symbol, bar_no, {columns} FROM indicator(TABLE(SELECT * FROM tidemill_bars) PARTITION BY symbol ORDER BY (bar_no), {call})")


@query("sql_rsi", stages(*[x.replace(repr(1 - 1 / 14), repr(1 - 1 / 7)).replace(repr(1 / 14), repr(1 / 7)) for x in RSI]) + f"SELECT symbol, bar_no, round(rsi, 6) AS rsi FROM s{len(RSI)}")
def sql_rsi(spark, sf_dir):
    """RSI of 7 bars."""
    return from_sql(spark, sf_dir, "round(rsi, 6) AS rsi", "'rsi', map('n', 7)")


@query("sql_supertrend", supertrend_sql(7, 2.0))
def sql_supertrend(spark, sf_dir):
    """Supertrend of 7 bars and a factor of 2."""
    columns = "round(supertrend, 6) AS supertrend, supertrend_dir, round(supertrend_upper, 6) AS supertrend_upper, round(supertrend_lower, 6) AS supertrend_lower"
    return from_sql(spark, sf_dir, columns, "'supertrend', map('n', 7, 'm', 2)")


@query("own_supertrend", supertrend_sql(5, 1.5))
def own_supertrend(spark, sf_dir):
    rows = parametric.with_indicator(series(spark, sf_dir), "supertrend", n=5, m=1.5)
    return rows.select("symbol", "bar_no", "supertrend_dir", *[F.round(c, 6).alias(c) for c in ("supertrend", "supertrend_upper", "supertrend_lower")])


@query("own_bollinger", stages(f"{roll('avg', 'close', 9)} AS m, {roll('stddev_samp', 'close', 9)} AS sd") + "SELECT symbol, bar_no, round(m, 6) AS bb_mid, round(m + 1.5 * sd, 6) AS bb_upper, round(m - 1.5 * sd, 6) AS bb_lower FROM s1")
def own_bollinger(spark, sf_dir):
    rows = parametric.with_indicator(series(spark, sf_dir), "bollinger", n=9, k=1.5)
    return rows.select("symbol", "bar_no", *[F.round(c, 6).alias(c) for c in ("bb_mid", "bb_upper", "bb_lower")])


@query("own_atr", stages(PC, f"{TR} AS tr", f"{ewm('tr', 1 / 5)} AS atr") + "SELECT symbol, bar_no, round(atr, 6) AS atr FROM s3")
def own_atr(spark, sf_dir):
    return parametric.with_indicator(series(spark, sf_dir), "atr", n=5).select("symbol", "bar_no", F.round("atr", 6).alias("atr"))
