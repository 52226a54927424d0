"""Tick CSV files of trading terminals: legacy encodings, headers by keyword or by position, dates in cells or names."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import file_of, stored

#: Encodings of the source files, in the order in which they are tried.
ENCODINGS = ("cp949", "euc-kr", "utf-8", "utf-8-sig", "latin1")
#: Header words of the source files.
WORDS = {
    "time": ("시간", "time", "체결시간", "일자"), "price": ("현재가", "체결가", "price", "close", "종가", "지수"),
    "volume": ("체결량", "volume", "qty", "수량", "거래량"), "side": ("매도수", "매수매도", "구분", "side"),
}
RAW = "file string, line bigint, time string, price string, volume string, side string"


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin1")


def columns_of(first: list[str]) -> tuple[dict[str, int], bool]:
    """Places of time, price, volume (and side), and whether the line was a header."""
    names = ["".join(x.split()).lower().lstrip("﻿") for x in first]
    found = {k: next((i for i, n in enumerate(names) if any(w in n for w in words)), None) for k, words in WORDS.items()}
    if found["time"] is not None and found["price"] is not None:
        return {k: i for k, i in found.items() if i is not None}, True
    if len(first) >= 19:
        return {"time": 1, "price": 5, "volume": 8}, not first[5].replace(",", "").replace(".", "").lstrip("+-").isdigit()
    place = {"time": 0, "price": 1, "volume": 4 if len(first) > 4 else 2}
    return place, len(first) > 1 and not first[1].replace(",", "").replace(".", "").lstrip("+-").isdigit()


#: Characters of a file that a task decodes at once, and lines that it hands on at once.
PIECE, LINES = 1 << 20, 10_000


def encoding_of(file: BinaryIO) -> str:
    """The first of the ENCODINGS that the whole file is in, read piece by piece."""
    for encoding in ENCODINGS:
        file.seek(0)
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            while piece := file.read(PIECE):
                decoder.decode(piece)
            decoder.decode(b"", True)
            return encoding
        except UnicodeDecodeError:
            continue
    return "latin1"


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of files, some thousand at a time; a file is opened by its task and never held."""
    for frame in frames:
        for path in frame["path"]:
            files, within = file_of(path)
            with files.open_input_file(within) as file:
                encoding = encoding_of(file)
                file.seek(0)
                text = io.TextIOWrapper(io.BufferedReader(file, PIECE), encoding, newline="\n")
                rows = (r for r in csv.reader(text) if len(r) >= 3)
                first = next(rows, None)
                if first is None:
                    continue
                at, header = columns_of(first)
                rows, done = itertools.chain([] if header else [first], rows), 0
                while some := list(itertools.islice(rows, LINES)):
                    cells = [[r[at[k]].strip() if k in at and at[k] < len(r) else None for k in ("time", "price", "volume", "side")] for r in some]
                    out = pd.DataFrame(cells, columns=["time", "price", "volume", "side"], dtype=object)
                    out.insert(0, "line", range(done, done + len(out)))
                    out.insert(0, "file", path.rsplit("/", 1)[-1])
                    done += len(out)
                    yield out


def date_in_name(name: Column) -> Column:
    """The first plausible YYYYMMDD or YYMMDD (years from 70 on are of the last century), 1990 to 2035."""
    digits = F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{8}|\d{6})(?!\d)"), F.lit(1))
    full = F.transform(digits, lambda d: F.when(F.length(d) == 8, d).otherwise(F.concat(F.when(F.substring(d, 1, 2).cast("int") >= 70, "19").otherwise("20"), d)))
    days = F.transform(full, lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date"))
    return F.get(F.filter(days, lambda d: d.isNotNull() & F.year(d).between(1990, 2035)), F.lit(0))


def clock(time: Column) -> Column:
    """HH:MM:SS from H:MM:SS or up to six digits; any other form with a colon is midnight."""
    short = F.when(F.length(time) == 7, F.concat(F.lit("0"), time)).when(F.length(time) == 8, time).otherwise(F.lit("00:00:00"))
    digits = F.lpad(F.regexp_replace(time, r"\D", ""), 6, "0")
    packed = F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    return F.when(time.contains(":"), short).otherwise(packed)


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInPandas(_lines, RAW)


def scan_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file with lines: file, lines, bad_times (cells that are no time), no_price, and reversed, where the file
    runs from late to early."""
    rows = _raw(spark, path)
    dated = F.col("time").rlike("[-/]") & (F.length("time") >= 10)
    good = F.coalesce(dated | F.col("time").rlike(r"^\d{1,2}:\d{2}:\d{2}") | F.col("time").rlike(r"^\d{6}$"), F.lit(False))
    at = F.when(good, F.when(dated, F.replace("time", F.lit("/"), F.lit("-"))).otherwise(clock(F.col("time"))))
    price = F.regexp_replace("price", "[, ]", "").try_cast("double")
    rows = rows.withColumns({"_at": at, "_bad": ~good, "_none": price.isNull()})
    out = rows.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if("_bad").alias("bad_times"), F.count_if("_none").alias("no_price"),
        F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("line"))).alias("_a"), F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("line"))).alias("_b"),
    )
    return out.withColumn("reversed", F.coalesce(F.col("_a") > F.col("_b"), F.lit(False))).drop("_a", "_b")


def read_ticks(spark: SparkSession, path: str | list[str], symbol: str = "DEFAULT") -> DataFrame:
    """Ticks of all files below ``path`` (one or several). Files in falling order of time are turned round; seq follows the file's order.

    A file is read by one task, some thousand lines at a time. Rows without a price or a date are dropped,
    missing volumes are 1. An empty file gives no rows.
    """
    raw = _raw(spark, path)
    number = lambda c: F.regexp_replace(F.col(c), "[, ]", "").try_cast("double")
    dated = F.col("time").rlike("[-/]") & (F.length("time") >= 10)
    day = F.when(dated, F.try_to_timestamp(F.replace(F.substring("time", 1, 10), F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd")).cast("date")).otherwise(date_in_name(F.col("file")))
    at = F.when(dated, F.when(F.length("time") > 10, F.substring("time", 12, 8)).otherwise("00:00:00")).otherwise(clock(F.col("time")))
    rows = raw.select("file", "line", "side", F.abs(number("price")).alias("price"), F.abs(number("volume")).alias("volume"), F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), at)).cast("timestamp_ntz").alias("ts"))
    rows = rows.where("price is not null and ts is not null").withColumn("volume", F.coalesce("volume", F.lit(1.0)).cast("bigint"))
    ends = rows.groupBy("file").agg(F.min_by("ts", "line").alias("_a"), F.max_by("ts", "line").alias("_b"))
    rows = rows.join(ends, "file").withColumn("line", F.when(F.col("_a") > F.col("_b"), -F.col("line")).otherwise(F.col("line")))
    seq = F.row_number().over(Window.partitionBy("file").orderBy("ts", "line")).cast("bigint")
    return rows.select(
        "ts", F.struct("file", seq.alias("n")).alias("seq"), F.lit(symbol).alias("symbol"), "price", "volume", F.to_date("ts").alias("trade_date"),
        F.col("price").alias("bid"), F.col("price").alias("ask"), F.col("file").alias("file_source"), "side",
    )


FILES = "file_name string, file_path string, file_size bigint, modified timestamp"
MANIFEST = FILES + ", file_hash string, row_count bigint, synced_at timestamp, max_price double, min_price double"


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, path, size and time of the CSV files below ``path`` (one or several, or joined by semicolons), without reading
    them; of names that differ in case only one stays."""
    paths = [x.strip() for x in path.split(";") if x.strip()] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").load(paths)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    last = F.row_number().over(Window.partitionBy(F.lower("file_name")).orderBy(F.desc("file_path")))
    return files.withColumn("_n", last).where("_n = 1").drop("_n")


def fingerprints(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_path and file_hash of files: MD5 of size, first and last 8 KB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, 8192)
    tail = F.when(F.col("length") > 16384, F.expr("substring(content, -8192, 8192)")).otherwise(F.lit("").cast("binary"))
    return files.select(F.col("path").alias("file_path"), F.md5(F.concat(F.col("length").cast("string").cast("binary"), head, tail)).alias("file_hash"))


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """What has been loaded; empty where nothing has."""
    try:
        return spark.read.schema(MANIFEST).parquet(manifest)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


@dataclass(frozen=True)
class Bounds:
    """A loaded file is suspect with a price beyond these, with fewer rows, or without figures in the manifest."""

    most: float = 5000.0
    least: float = 10.0
    rows: int = 2000


def suspect_rows(manifest: DataFrame, bounds: Bounds) -> DataFrame:
    odd = (F.col("max_price") > bounds.most) | (F.col("min_price") < bounds.least) | (F.col("row_count") < bounds.rows)
    return manifest.where(F.coalesce(odd, F.lit(True)))


def to_sync(found: DataFrame, manifest: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
    """The listed files that are new, whose size or time differs from the manifest's, or whose ticks are suspect."""
    same = manifest.select("file_name", "file_size", "modified")
    if suspects is not None:
        same = same.join(suspects, "file_name", "left_anti")
    return found.join(same, ["file_name", "file_size", "modified"], "left_anti")


def sync(spark: SparkSession, path: str | list[str], table: str, manifest: str, full: bool = False, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """Load new, changed and suspect files into the Parquet table (one partition per file, replaced whole) and renew the
    manifest; ``full`` loads all files anew and forgets those that are gone. Only the files that are loaded are read: of
    the others size and time are compared, and of those that differ the hash. Files without ticks are tried again. What
    makes a file suspect is in the manifest, so of the table no more than the partitions just written is read."""
    found, known = listed(spark, path), read_manifest(spark, manifest)
    if full:
        known = known.limit(0)
    suspects = None
    if not known.isEmpty():
        suspects = suspect_rows(known, bounds).select("file_name")
    new = stored(to_sync(found, known, suspects), "to-sync")
    names = [r.file_path for r in new.select("file_path").collect()]  # a name for each file to load
    if names:
        hashes = fingerprints(spark, names)
        new = new.join(hashes, "file_path")
        if suspects is not None:  # touched, but the same
            same = known.join(suspects, "file_name", "left_anti").select("file_name", "file_hash")
            new = new.join(same, ["file_name", "file_hash"], "left_anti")
        new = stored(new, "to-load")
        names = [r.file_path for r in new.select("file_path").collect()]
    if names:
        ticks = read_ticks(spark, names).withColumn("seq", F.col("seq.n"))
        writer = ticks.write.mode("overwrite").partitionBy("file_source")
        (writer if full else writer.option("partitionOverwriteMode", "dynamic")).parquet(table)
        written = spark.read.parquet(table).join(F.broadcast(new.select(F.col("file_name").alias("file_source"))), "file_source")  # a name for each file just loaded
        figures = written.groupBy(F.col("file_source").alias("file_name")).agg(F.count("*").alias("row_count"), F.max("price").alias("max_price"), F.min("price").alias("min_price"))
        loaded = new.join(figures, "file_name").withColumn("synced_at", F.current_timestamp())
        kept = known.join(new, "file_name", "left_anti")
        columns = [x.split()[0] for x in MANIFEST.split(", ")]
        stored(kept.select(*columns).unionByName(loaded.select(*columns)), "manifest").write.mode("overwrite").parquet(manifest)
    return read_manifest(spark, manifest)


def sync_status(spark: SparkSession, table: str, manifest: str) -> DataFrame:
    """One row: files loaded and ticks they have."""
    return read_manifest(spark, manifest).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_ticks"))


def write_csv(ticks: DataFrame, path: str) -> None:
    """One ordered CSV file per day, named by its date. Days are written side by side, none is gathered with another."""
    rows = ticks.select(F.date_format("ts", "HH:mm:ss").alias("time"), "price", "volume", F.date_format("ts", "yyyyMMdd").alias("day"), "ts", "seq")
    rows = rows.repartition("day").sortWithinPartitions("day", "ts", "seq").drop("ts", "seq")
    rows.write.partitionBy("day").option("header", "true").mode("overwrite").csv(path)


def write_trades(trades: DataFrame, path: str, *by: str) -> None:
    """A trade log as CSV with a header, a folder for each series, in the order of the trades."""
    by = by or tuple(c for c in ("symbol", "bar_size", "strategy") if c in trades.columns)
    trades.repartition(*by).sortWithinPartitions(*by, "trade_no").write.partitionBy(*by).mode("overwrite").option("header", "true").csv(path)
