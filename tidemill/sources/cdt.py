"""CDT bar files: a header of two 32-bit numbers (kind, count) and records of 8 or 10 doubles.

The format is a data source of Spark's: ``read.format("cdt")`` and ``write.format("cdt")``. Tasks read and write through
pyarrow's file systems, a stretch of records or a batch at a time, so neither a file nor a series is ever held whole.
"""

from __future__ import annotations

import csv
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .csv_ticks import decoded, read_ticks
from .shared import file_system, stored

FIELDS = ("stamp", "open", "high", "low", "close", "volume", "trading_value", "open_interest")


def parse(data: bytes) -> pd.DataFrame:
    """Bars of one small file; the record width is that of the kind, else what the count and the size say."""
    if len(data) < 8:
        return pd.DataFrame({f: pd.Series(dtype=float) for f in FIELDS})
    width, count = layout(*struct.unpack_from("<2i", data), len(data) - 8)
    rows = np.frombuffer(data, "<f8", count * (width // 8), 8).reshape(-1, width // 8)[:, :8]
    return pd.DataFrame(rows, columns=list(FIELDS))


#: Header words of bar files.
BAR_WORDS = {
    "timestamp": ("일자시간", "timestamp", "datetime", "date"), "open": ("시가", "open"), "high": ("고가", "high"), "low": ("저가", "low"), "close": ("종가", "close"),
    "volume": ("거래량", "volume"), "trading_value": ("거래대금", "value"), "open_interest": ("미결제", "interest"),
}


def parse_csv(text: str) -> pd.DataFrame:
    """Bars of a CSV with a header, or without one: date, time, prices, volume (7 or more columns) or timestamp, prices, volume (6)."""
    rows = [r for r in csv.reader(io.StringIO(text)) if len(r) >= 5]
    names = ["timestamp", *FIELDS[1:]]
    if not rows:
        return pd.DataFrame(columns=names)
    head = [x.strip().lower().lstrip("\ufeff") for x in rows[0]]
    at = {k: next((i for i, h in enumerate(head) if any(w in h for w in words)), None) for k, words in BAR_WORDS.items()}
    number = lambda x: float(x.replace(",", "")) if x and x.strip() else 0.0
    out = []
    if None not in [at[k] for k in ("timestamp", "open", "high", "low", "close")]:
        for r in rows[1:]:
            out.append([r[at["timestamp"]].strip(), *(number(r[at[k]]) if at[k] is not None and at[k] < len(r) else 0.0 for k in names[1:])])
    else:
        for r in rows:
            if len(r) >= 7:
                d, t = r[0].strip(), r[1].strip().zfill(6)
                out.append([f"{d[:4]}-{d[4:6]}-{d[6:8]} {t[:2]}:{t[2:4]}:{t[4:6]}", *map(number, r[2:7]), 0.0, 0.0])
            elif len(r) == 6:
                out.append([r[0].strip(), *map(number, r[1:6]), 0.0, 0.0])
    return pd.DataFrame(out, columns=names)


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    """file and bars of every .csv file in one of the forms of ``parse_csv``; a file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                yield parse_csv(decoded(bytes(content))).assign(file=path_.rsplit("/", 1)[-1])

    return files.select("path", "content").mapInPandas(run, "timestamp string, " + ", ".join(f"{f} double" for f in FIELDS[1:]) + ", file string")


#: Records that a task reads at once.
STRETCH = 65_536


def layout(kind: int, count: int, body: int) -> tuple[int, int]:
    """Bytes of a record and number of records of a file with so many bytes after its header."""
    width = {1: 64, 3: 80}.get(kind)
    if width is None or count <= 0 or body % width or body // width != count:
        width = body // count if count > 0 and body % count == 0 and body // count % 8 == 0 and body // count >= 64 else 64
    return width, body // width


#: Columns of the data source.
SOURCE = "file string, " + ", ".join(f"{f} double" for f in FIELDS)


def read(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """file and bars of every .cdt file; timestamps stay text, prices have two decimals."""
    register(spark)
    return with_timestamps(spark.read.format("cdt").option("stretch", stretch).load(path)).select(*FIELDS[1:], "file", "timestamp")


class CdtSource(DataSource):
    """The format ``cdt``: every .cdt file below a path, raw, and what writes such files.

    Read options: ``stretch`` (records of a partition), ``names`` (of files, comma-joined; default all). Rows to write have the columns of SOURCE in any order and
    ``records``, how many a file has; those of a file must be in one partition and in their order.
    """

    @classmethod
    def name(cls) -> str:
        return "cdt"

    def schema(self) -> str:
        return SOURCE

    def reader(self, schema):
        return CdtReader(self.options)

    def writer(self, schema, overwrite: bool):
        return CdtWriter(self.options["path"], overwrite)


class Stretch(InputPartition):
    def __init__(self, path: str, size: int, at: int, end: int):
        self.path, self.size, self.at, self.end = path, size, at, end


class CdtReader(DataSourceReader):
    """Plans from sizes of files alone: a partition is a stretch of bytes after the header and has the records that begin in
    it. Files are chosen by an option, not by filters pushed down: Spark plans a source once for all queries of one frame,
    so a filter of one query would hold for the others."""

    def __init__(self, options):
        names = options.get("names")
        self.path, self.stretch, self.names = options["path"], int(options.get("stretch", STRETCH)), names and set(names.split(","))

    def partitions(self):
        from pyarrow import fs

        files, root = file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if not root.endswith(".cdt") else [files.get_file_info(root)]
        out, length = [], self.stretch * 64
        for x in sorted((x for x in found if x.is_file and x.path.endswith(".cdt")), key=lambda x: x.path):
            hidden = any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/"))
            if not hidden and x.size >= 8 and (not self.names or x.base_name in self.names):
                out += [Stretch(x.path, x.size, at, min(at + length, x.size - 8)) for at in range(0, max(1, x.size - 8), length)]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        files, _ = file_system(self.path)
        with files.open_input_file(partition.path) as f:
            width, count = layout(*struct.unpack("<2i", f.read_at(8, 0)), partition.size - 8)
            first, last = -(-partition.at // width), min(-(-partition.end // width), count)
            if last > first:
                cells = np.frombuffer(f.read_at((last - first) * width, 8 + first * width), "<f8").reshape(last - first, -1)[:, :8]
                name = pa.array([partition.path.rsplit("/", 1)[-1]] * len(cells))
                yield pa.RecordBatch.from_arrays([name, *[pa.array(np.ascontiguousarray(c)) for c in cells.T]], ["file", *FIELDS])


@dataclass
class Written(WriterCommitMessage):
    files: list


class CdtWriter(DataSourceArrowWriter):
    """A task writes into a hidden folder of its own; the driver moves the files of the tasks that count to their places when
    all have ended, so that what a failed or repeated task has written is never seen."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.hidden = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        files, root = file_system(self.path)
        folder, out, now, done = f"{root}/{self.hidden}/{uuid.uuid4().hex}", None, None, []
        for batch in iterator:
            names = batch["file"].to_pylist()
            cells = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in FIELDS]).astype("<f8") if names else None
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and names[a] != now:
                    if out:
                        out.close()
                    now = names[a]
                    if now in done:
                        raise ValueError(f"rows of {now} are not together")
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{now}")
                    out.write(struct.pack("<2i", 1, batch["records"][a].as_py()))
                    done.append(now)
                if b > a:
                    out.write(cells[a:b].tobytes())
        if out:
            out.close()
        return Written([f"{folder}/{name}" for name in done])

    def commit(self, messages):
        files, root = file_system(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        if len({f.rsplit("/", 1)[-1] for f in made}) < len(made):
            self.abort(messages)
            raise ValueError("rows of a file were in several partitions")
        if self.overwrite:
            from pyarrow import fs

            for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.is_file and x.path.endswith(".cdt"):
                    files.delete_file(x.path)
        for f in made:
            files.move(f, f"{root}/{f.rsplit('/', 1)[-1]}")
        self._clear(files, root)

    def abort(self, messages):
        files, root = file_system(self.path)
        self._clear(files, root)

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.hidden}")


def register(spark: SparkSession) -> None:
    """Makes the format ``cdt`` known to a session."""
    spark.dataSource.register(CdtSource)


def with_timestamps(rows: DataFrame) -> DataFrame:
    text = F.rpad(F.col("stamp").cast("decimal(20,0)").cast("string"), 14, "0")
    stamp = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return rows.withColumn("timestamp", stamp).withColumns({c: F.round(c, 2) for c in FIELDS[1:5]}).drop("stamp")


def write(bars: DataFrame, by: str, path: str, at: str = "open_time") -> DataFrame:
    """One file <value>.cdt below ``path`` for each value of ``by``, its bars in order of time; (by, file, records).

    Bars without a time have the fixed one of the format; missing prices and volumes are 0; trading value is close times
    volume unless there is a column for it. Rows stream into the files, which appear together when all are written; files of
    other names stay.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in bars.columns else F.lit(0.0)
    value = number("trading_value") if "trading_value" in bars.columns else number("close") * number("volume")
    rows = bars.select(
        F.col(by).cast("string").alias(by), F.col(at).alias("_at"), F.coalesce(F.date_format(at, "yyyyMMddHHmmss"), F.lit("20240101090000")).cast("double").alias("stamp"),
        *[number(c).alias(c) for c in FIELDS[1:6]], value.alias("trading_value"), number("open_interest").alias("open_interest"),
    )
    counts = stored(rows.groupBy(by).agg(F.count("*").alias("records")), "cdt-counts")
    rows = rows.join(counts, by).withColumn("file", F.concat(by, F.lit(".cdt"))).repartition("file").sortWithinPartitions("file", "_at")
    register(bars.sparkSession)
    rows.select("file", *FIELDS, "records").write.format("cdt").mode("append").save(path)
    return counts.select(by, F.concat(by, F.lit(".cdt")).alias("file"), "records")


def csv_to_cdt(spark: SparkSession, source: str | list[str], path: str) -> DataFrame:
    """Every tick CSV of ``source`` (a file, a folder, several) as a CDT file of its own name; (name, file, records)."""
    ticks = read_ticks(spark, source)
    rows = ticks.select(F.regexp_replace("file_source", r"\.[^.]*$", "").alias("name"), "ts", *[F.col("price").alias(c) for c in FIELDS[1:5]], "volume", F.lit(0.0).alias("trading_value"), F.lit(0.0).alias("open_interest"))
    return write(rows, "name", path, "ts")
