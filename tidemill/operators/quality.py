"""Cleaning of ticks, daily quality, catalogue figures and period filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lagged, quantiles


def tick_sides(ticks: DataFrame, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """side by the tick rule: 1 after a rise, -1 after a fall, 0 otherwise and on a day's first tick."""
    rows = lagged(ticks, by, F.date_trunc("minute", "ts"), ("ts", "seq"), {"_last": "price"})
    return rows.withColumn("side", F.coalesce(F.signum(F.col("price") - F.col("_last")).cast("int"), F.lit(0))).drop("_last")


def side_of_text(text: Column) -> Column:
    """1 for words of buying, -1 for words of selling, else 0 (fixed values of the source files)."""
    t = F.lower(text)
    return F.when(t.rlike(r"매수|buy|\+|▲"), 1).when(t.rlike(r"매도|sell|-|▼"), -1).otherwise(0)


def in_range(ticks: DataFrame, low: float = 50.0, high: float = 600.0) -> DataFrame:
    return ticks.where((F.col("price") > 0) & F.col("price").between(low, high))


def first_of(ticks: DataFrame, *columns: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Of rows alike in ``columns`` the first in ``order``."""
    w = Window.partitionBy(*columns).orderBy(*order)
    return ticks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def halts(ticks: DataFrame, seconds: int = 900, opens: str = "09:00:00", closes: str = "15:30:00") -> DataFrame:
    """Gaps of more than ``seconds`` within a day that begin during the session."""
    rows = lagged(ticks.select("trade_date", "ts", "seq"), ["trade_date"], F.date_trunc("minute", "ts"), ("ts", "seq"), {"halt_from": "ts"})
    rows = rows.select("trade_date", "halt_from", F.col("ts").alias("halt_to"))
    at = F.date_format("halt_from", "HH:mm:ss")
    return rows.where((F.expr("timestampdiff(MICROSECOND, halt_from, halt_to)") > seconds * 1_000_000) & at.between(opens, closes))


def daily_quality(ticks: DataFrame, low: float = 50.0, high: float = 600.0) -> DataFrame:
    """Per day: ticks, zero or negative and out-of-range prices, repeats, ticks kept, halts and a status."""
    good = in_range(ticks, low, high)
    counts = ticks.groupBy("trade_date").agg(
        F.count("*").alias("ticks"), F.count_if(F.col("price") <= 0).alias("not_positive"), F.count_if(~F.col("price").between(low, high)).alias("out_of_range")
    )
    kept = first_of(good, "trade_date", "ts", "price", "volume")
    days = kept.groupBy("trade_date").agg(F.count("*").alias("kept"))
    stops = halts(kept).groupBy("trade_date").agg(F.count("*").alias("halts"))
    out = counts.join(days, "trade_date", "left").join(stops, "trade_date", "left").fillna(0, ["kept", "halts"])
    passed = good.groupBy("trade_date").agg(F.count("*").alias("good"))
    out = out.join(passed, "trade_date", "left").fillna(0, ["good"]).withColumn("repeats", F.col("good") - F.col("kept")).drop("good")
    status = F.when(F.col("kept") < 50, "CORRUPTED").when((F.col("not_positive") > 0) | (F.col("out_of_range") > 0), "WARNING").otherwise("PASSED")
    return out.withColumn("status", status)


def quality_totals(days: DataFrame) -> DataFrame:
    return days.agg(*[F.sum(c).alias(c) for c in ("ticks", "not_positive", "out_of_range", "repeats", "kept", "halts")], F.count_if(F.col("status") != "PASSED").alias("days_not_passed"))


def clean(ticks: DataFrame) -> DataFrame:
    """Ticks with a side, in range, without repeats of (ts, price, volume)."""
    return first_of(in_range(tick_sides(ticks)), "trade_date", "ts", "price", "volume")


def suspect_sources(ticks: DataFrame, source: str, most: float = 5000.0, least: float = 10.0, rows: int = 2000) -> DataFrame:
    """Sources with a price beyond the bounds or too few rows."""
    found = ticks.groupBy(source).agg(F.max("price").alias("max_price"), F.min("price").alias("min_price"), F.count("*").alias("ticks"))
    return found.where((F.col("max_price") > most) | (F.col("min_price") < least) | (F.col("ticks") < rows))


def suspect_files(files: DataFrame, ticks: DataFrame, large: int = 500_000, rows: int = 2000) -> DataFrame:
    """Names of files (file_name, file_size) to load again: suspect by their ticks, or large with few of them."""
    bad = suspect_sources(ticks, "file_source").select(F.col("file_source").alias("file_name"))
    counts = ticks.groupBy(F.col("file_source").alias("file_name")).agg(F.count("*").alias("ticks"))
    short = files.join(counts, "file_name", "left").where((F.col("file_size") > large) & (F.coalesce("ticks", F.lit(0)) < rows)).select("file_name")
    return bad.unionByName(short).distinct()


def overview(ticks: DataFrame) -> DataFrame:
    return ticks.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("trade_date").alias("days"), F.count("*").alias("ticks"))


def by_period(ticks: DataFrame, pattern: str = "yyyy") -> DataFrame:
    return ticks.groupBy(F.date_format("ts", pattern).alias("period")).agg(
        F.countDistinct("trade_date").alias("days"), F.count("*").alias("ticks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def available(ticks: DataFrame, pattern: str) -> DataFrame:
    """Days, months or years that have ticks."""
    return ticks.select(F.date_format("ts", pattern).alias("period")).distinct().orderBy("period")


def symbols(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.count("*").alias("ticks")).orderBy("symbol")


def latest(ticks: DataFrame, n: int = 15_000, low: float = 50.0, high: float = 2000.0) -> DataFrame:
    """The last ``n`` plausible ticks; with the total order the result is the same on every run."""
    return ticks.where((F.col("price") > low) & (F.col("price") < high)).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def period_bounds(kind: str, value: str, end: str | None = None) -> tuple[str | None, str | None]:
    """First and last moment of a YEAR, MONTH, DAY, CUSTOM range or ALL."""
    import calendar

    if kind == "ALL":
        return None, None
    if kind == "CUSTOM":
        return f"{value} 00:00:00", f"{end or value} 23:59:59"
    if kind == "YEAR":
        return f"{value}-01-01 00:00:00", f"{value}-12-31 23:59:59"
    if kind == "MONTH":
        year, month = map(int, value.split("-"))
        return f"{value}-01 00:00:00", f"{value}-{calendar.monthrange(year, month)[1]:02d} 23:59:59"
    return f"{value} 00:00:00", f"{value} 23:59:59"


def in_period(rows: DataFrame, column: str, kind: str, value: str = "", end: str | None = None) -> DataFrame:
    """Rows whose text timestamp lies in a YEAR, MONTH or DAY (a prefix), a CUSTOM range of days or ALL."""
    if kind == "ALL":
        return rows
    if kind == "CUSTOM":
        return rows.where((F.col(column) >= value) & (F.col(column) <= f"{end or value} 23:59:59"))
    return rows.where(F.col(column).startswith(value))


def close_filter(bars: DataFrame, least: int = 10) -> DataFrame:
    """Of series with more than ``least`` bars (with a close), those whose close is within 0.2 to 5 times the series' median."""
    by = [c for c in ("symbol", "bar_size") if c in bars.columns]
    mid = quantiles(bars, by, "close", [0.5]).select(*by, F.col("quantiles")[0].alias("_median"), F.col("n").alias("_n"))
    near = (F.col("close") > 0.2 * F.col("_median")) & (F.col("close") < 5 * F.col("_median"))
    return bars.join(mid, by).where((F.col("_n") <= least) | near).drop("_median", "_n")


def merge_bars(parts: list[DataFrame]) -> DataFrame:
    """Bars of several files: one of those alike in time and prices stays, missing numbers become 0, vwap is each bar's close unless given."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.withColumn("timestamp", F.replace("timestamp", F.lit("/"), F.lit("-"))).dropDuplicates(["timestamp", "open", "high", "low", "close", "volume"])
    numbers = [c for c in ("open", "high", "low", "close", "volume", "trading_value", "open_interest") if c in out.columns]
    out = out.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers})
    return out if "vwap" in out.columns else out.withColumn("vwap", F.col("close"))
