"""Periods, exports, file names and quality totals over the events as ticks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import quality as Q
from ..sources import csv_ticks
from ..sources.shared import shared_path
from .more_queries import BAR_COLUMNS, BY_TICK, CLEAN, RANKED, SIDES, bars_sql, daily_quality, out
from .sql import SERIES, TICKS
from .tick_queries import query, series

SIZES = tuple(B.sweep_sizes(60, 20, 15))


@query("tick_bars_range", bars_sql(BY_TICK, SIZES, "k", RANKED.format("t")))
def tick_bars_range(spark, sf_dir):
    """Bars of the sizes of a range whose bounds stand in the wrong order."""
    return out(B.tick_bars(B.event_ticks(spark, sf_dir), SIZES), *BAR_COLUMNS)


@query("period_ticks", f"WITH {TICKS} SELECT seq, ts, price FROM t WHERE ts >= '2024-01-10 00:00:00' AND ts <= '2024-01-10 23:59:59'")
def period_ticks(spark, sf_dir):
    """The ticks of a day, by the bounds of its period."""
    start, end = Q.period_bounds("DAY", "2024-01-10")
    return B.select_ticks(B.event_ticks(spark, sf_dir), start=start, end=end).select("seq", "ts", "price")


@query(
    "period_bars",
    f"""WITH {SERIES}, x AS (SELECT symbol, bar_no, strftime(open_time, '%Y-%m-%d %H:%M:%S') AS stamp FROM bars)
SELECT 'MONTH' AS kind, symbol, bar_no FROM x WHERE stamp LIKE '2024-01%' UNION ALL SELECT 'CUSTOM', symbol, bar_no FROM x WHERE stamp >= '2024-01-05' AND stamp <= '2024-01-12 23:59:59'""",
)
def period_bars(spark, sf_dir):
    """The bars of a month and of a range of days, by text timestamps."""
    rows = series(spark, sf_dir).select("symbol", "bar_no", F.date_format("open_time", "yyyy-MM-dd HH:mm:ss").alias("at"))
    month = Q.in_period(rows, "at", "MONTH", "2024-01").select(F.lit("MONTH").alias("kind"), "symbol", "bar_no")
    return month.unionByName(Q.in_period(rows, "at", "CUSTOM", "2024-01-05", "2024-01-12").select(F.lit("CUSTOM").alias("kind"), "symbol", "bar_no"))


@query(
    "suspect_files",
    f"""WITH {TICKS}, f AS (SELECT CAST(trade_date AS VARCHAR) AS file_name, count(*) AS n, max(price) AS hi, min(price) AS lo FROM t GROUP BY 1)
SELECT file_name FROM f WHERE hi > 5000 OR lo < 10 OR n < 2000""",
)
def suspect_files(spark, sf_dir):
    """Days as files: those to load again."""
    ticks = B.event_ticks(spark, sf_dir).withColumn("file_source", F.col("trade_date").cast("string"))
    files = ticks.groupBy(F.col("file_source").alias("file_name")).agg((F.count("*") * 300).alias("file_size"))
    return Q.suspect_files(files, ticks)


@query("file_dates", f"WITH {TICKS} SELECT DISTINCT strftime(trade_date, '%y%m%d') || '.csv' AS short_name, CAST(trade_date AS VARCHAR) AS short_date, CAST(trade_date AS VARCHAR) AS long_date FROM t")
def file_dates(spark, sf_dir):
    """Dates read from file names of two forms."""
    days = B.event_ticks(spark, sf_dir).select("trade_date").distinct()
    days = days.select(F.date_format("trade_date", "yyMMdd").alias("s"), F.date_format("trade_date", "yyyyMMdd").alias("l")).select(F.concat("s", F.lit(".csv")).alias("short_name"), F.concat(F.lit("ticks_"), "l", F.lit(".csv")).alias("long_name"))
    return days.select("short_name", *[csv_ticks.date_in_name(F.col(f"{k}_name")).cast("string").alias(f"{k}_date") for k in ("short", "long")])


@query("export_csv", f"WITH {TICKS} SELECT strftime(trade_date, '%Y%m%d') AS day, strftime(ts, '%H:%M:%S') AS time, count(*) AS ticks, round(sum(price), 4) AS price, CAST(sum(volume) AS BIGINT) AS volume FROM t GROUP BY 1, 2")
def export_csv(spark, sf_dir):
    """The ticks exported as CSV by day and read back by Spark."""
    path = shared_path(spark, "export")
    csv_ticks.write_csv(B.event_ticks(spark, sf_dir), path)
    back = spark.read.option("header", "true").schema("time string, price double, volume bigint, day string").csv(path)
    return back.groupBy("day", "time").agg(F.count("*").alias("ticks"), F.round(F.sum("price"), 4).alias("price"), F.sum("volume").alias("volume"))


@query(
    "quality_totals",
    f"""WITH {TICKS}{SIDES}{CLEAN},
n AS (SELECT trade_date, count(*) AS ticks, count(*) FILTER (price <= 0) AS not_positive, count(*) FILTER (NOT price BETWEEN 50 AND 600) AS out_of_range, count(*) FILTER (price > 0 AND price BETWEEN 50 AND 600) AS good FROM t GROUP BY trade_date),
k AS (SELECT trade_date, count(*) AS kept FROM c GROUP BY trade_date),
g AS (SELECT trade_date, ts, lag(ts) OVER (PARTITION BY trade_date ORDER BY ts, seq) AS f FROM c),
h AS (SELECT trade_date, count(*) AS halts FROM g WHERE epoch_us(ts) - epoch_us(f) > 900000000 AND strftime(f, '%H:%M:%S') BETWEEN '09:00:00' AND '15:30:00' GROUP BY trade_date)
SELECT CAST(sum(ticks) AS BIGINT) AS ticks, CAST(sum(not_positive) AS BIGINT) AS not_positive, CAST(sum(out_of_range) AS BIGINT) AS out_of_range, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS kept, CAST(sum(coalesce(halts, 0)) AS BIGINT) AS halts,
  CAST(sum(good - coalesce(kept, 0)) AS BIGINT) AS repeats, count(*) FILTER (coalesce(kept, 0) < 50 OR not_positive > 0 OR out_of_range > 0) AS days_not_passed FROM n LEFT JOIN k USING (trade_date) LEFT JOIN h USING (trade_date)""",
)
def quality_totals(spark, sf_dir):
    return Q.quality_totals(daily_quality(spark, sf_dir))
