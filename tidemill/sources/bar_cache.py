"""Bars kept as Parquet by what they are (kind, size, symbol, filter, range) and day.

A folder of the cache is one series' day, so a read touches only the days and columns that it asks for, and bars of another
kind, filter or range never replace each other. For each day the cache knows a fingerprint of the ticks that its bars were
made of; ``refresh`` compares it with that of the ticks now and makes only the days anew that differ. The fingerprints are
a table of versions of which the last counts, written after the bars: a refresh that is cut short is done again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

ANY = "ALL"


@dataclass(frozen=True)
class Key:
    """What bars are. kind: tick or volume; size: of a bar; symbol: None for all together; filter: name of the filter that
    the ticks have passed; start, end: bounds of the ticks."""

    kind: str
    size: int
    symbol: str | None = None
    filter: str = "none"
    start: str | None = None
    end: str | None = None

    def name(self) -> str:
        """One folder name for a key; characters that a path could take amiss are written as their numbers."""
        parts = (self.kind, str(self.size), self.symbol or ANY, self.filter, self.start or "", self.end or "")
        return "~".join("".join(c if c.isalnum() and c.isascii() or c in "-_" else f"%{ord(c):x}%" for c in p) for p in parts)


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    files, at = _folder(spark, path)
    found = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))


def write(bars: DataFrame, root: str, key: Key) -> None:
    """Replace the days (trade_date) of the key that ``bars`` has and leave all others. An empty frame writes nothing."""
    dealt = bars.withColumn("day", F.col("trade_date").cast("string"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/bars/{key.name()}")


def read(spark: SparkSession, root: str, key: Key, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """Cached bars of a key whose open_time lies within the bounds; None where nothing is cached. Bounds leave out the folders
    of other days."""
    path = f"{root}/bars/{key.name()}"
    if not _names(spark, path, "day="):
        return None
    rows = spark.read.option("basePath", path).parquet(path)
    day = F.col("day").cast("string")
    for keep in (
        (day >= start[:10]) & (F.col("open_time") >= F.lit(start).cast("timestamp_ntz")) if start else None,
        (day <= end[:10]) & (F.col("open_time") <= F.lit(end).cast("timestamp_ntz")) if end else None,
    ):
        rows = rows.where(keep) if keep is not None else rows
    return rows.select(*(columns or [c for c in rows.columns if c != "day"]))


def fingerprints(ticks: DataFrame) -> DataFrame:
    """``day, ticks, print``: a day's number of ticks and the sum of their hashes, whatever their order."""
    whole = F.xxhash64("ts", "seq", "symbol", "price", "volume").cast("decimal(38,0)")
    return ticks.groupBy(F.col("trade_date").cast("string").alias("day")).agg(F.count("*").alias("ticks"), F.sum(whole).cast("string").alias("print"))


def _prints(root: str, key: Key, version: int) -> str:
    return f"{root}/prints/{key.name()}/v={version:08d}"


def _versions(spark: SparkSession, root: str, key: Key) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{root}/prints/{key.name()}", "v="))


def _known(spark: SparkSession, root: str, key: Key) -> DataFrame:
    schema, versions = "day string, ticks bigint, print string", _versions(spark, root, key)
    return spark.read.schema(schema).parquet(_prints(root, key, versions[-1])) if versions else spark.createDataFrame([], schema)


def refresh(ticks: DataFrame, root: str, key: Key, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring a key's bars up to date with ``ticks``; ``make`` turns ticks of whole days into bars that start anew each day.

    Returns ``day, ticks, action`` (made, kept or dropped). Only days whose ticks have changed are read again by ``make``;
    days without ticks lose their folder. No ticks at all empties the key.
    """
    spark = ticks.sparkSession
    if key.symbol is not None:
        ticks = ticks.where(F.col("symbol") == key.symbol)
    for bound, keep in ((key.start, lambda v: F.col("ts") >= F.lit(v).cast("timestamp_ntz")), (key.end, lambda v: F.col("ts") <= F.lit(v).cast("timestamp_ntz"))):
        ticks = ticks.where(keep(bound)) if bound else ticks
    now = stored(fingerprints(ticks), "fingerprints")
    old = _known(spark, root, key).select("day", F.col("print").alias("_print"), F.col("ticks").alias("_ticks"))
    same = F.col("print").eqNullSafe(F.col("_print")) & F.col("ticks").eqNullSafe(F.col("_ticks"))
    action = F.when(F.col("print").isNull(), "dropped").when(same, "kept").otherwise("made")
    plan = stored(now.join(old, "day", "full").select("day", F.coalesce("ticks", F.lit(0)).alias("ticks"), action.alias("action")), "refresh")
    todo = plan.where("action = 'made'").select(F.col("day").cast("date").alias("trade_date"))  # a row for each day
    if todo.limit(1).count():
        write(make(ticks.join(todo, "trade_date", "left_semi")), root, key)
    for r in plan.where("action = 'dropped'").select("day").toLocalIterator():
        files, at = _folder(spark, f"{root}/bars/{key.name()}/day={r.day}")
        files.delete(at, True)
    versions = _versions(spark, root, key)
    now.write.parquet(_prints(root, key, (versions[-1] if versions else 0) + 1))
    for v in versions[:-1]:  # the last but one stays for readers that have begun
        files, at = _folder(spark, _prints(root, key, v))
        files.delete(at, True)
    return plan


def keys(spark: SparkSession, root: str) -> list[str]:
    """Names of the keys that have bars."""
    return _names(spark, f"{root}/bars", "")


def clear(spark: SparkSession, root: str) -> int:
    """Drop all that is cached; the number of keys that were."""
    files, at = _folder(spark, root)
    n = len(keys(spark, root))
    if files.exists(at):
        files.delete(at, True)
    return n
