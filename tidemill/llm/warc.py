"""WARC archives: writing with revisit records, and reading in parallel by boundary-chain verification.

Archives are UTF-8 text to Spark's text writer (one record per row, the blank lines after a record as line separator),
so they can be written to and read from any store that Spark reaches; uncompressed ones are read in splits. Reading cuts
files at the magic line ``WARC/1.0``, wherever it stands, also inside payloads. Every cut is a candidate record: its task
reads the header and emits the offset of the candidate and of its successor (header + Content-Length + blank lines).
Tasks cut what they read into stretches of some megabytes, which bounds what they hold. Within a stretch the chains are
followed at once, so that a candidate's pointer leads out of its stretch; pointer jumping over the stretches then finds
which candidates can be reached from the start of each file, and only those are records. The magic inside a payload has no
such chain. Payloads that hold the magic are put together from their pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Bytes that a task reads before it passes on its candidates: chains are followed within such a stretch at once, and from
#: stretch to stretch by pointer jumping.
STRETCH = 2 << 20
#: Records of an archive; a larger task writes several archives.
FILE_RECORDS = 100_000
#: Revisits (about 100 bytes each) that may be sent to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))


def archive_rows(pages: DataFrame) -> DataFrame:
    """One row ``value`` per page: its record without the blank lines that end it."""
    pages = pages.select("page_id", F.regexp_replace("url", "[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    prints = pages.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest", F.sha2("html", 256).alias("full"))
    leaders = prints.groupBy("digest", "full").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where("copies > 1")
    # Few columns and no payload pass through the join on digests, where a popular page is a hot key.
    later = prints.join(leaders.select("digest", "full", "leader"), ["digest", "full"]).where("not page_id <=> leader")
    later = written(later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "leader").distinct(), "warc-revisits")
    later = F.broadcast(later) if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else later
    rows = pages.join(later, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("n") >= REVISIT_BYTES), "left")
    again = F.col("leader").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("html")))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", page("page_id")),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("n")),
        F.when(again, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _line("WARC-Refers-To", page("leader")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(BLANK),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Write one archive per task and FILE_RECORDS pages. Null html is an empty payload, null urls and ids are empty fields; an empty table
    writes no record. Of equal payloads of REVISIT_BYTES or more the largest page_id is the response and the others
    revisit it; rows that repeat an id and a payload are alike. Payloads may be of any length that a row may have; other
    columns are not read. Uncompressed archives can be read in splits, gzip ones a file by one task."""
    archive_rows(pages).write.option("lineSep", BLANK).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


CANDIDATE = (
    "file string, block bigint, stretch bigint, idx bigint, rel bigint, size bigint, next bigint, leaves bigint, complete boolean, type string, record string, uri string,"
    " refers string, payload_bytes bigint, payload_digest string"
)


def header_of(piece: bytes) -> tuple[int, dict[str, str]]:
    """Length of the header with its blank line, and its fields in lower case; length 0 if there is none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return 0, {}
    fields = (x.partition(":") for x in piece[:end].decode("utf-8", "replace").split("\r\n"))
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in fields}


def describe(block: bytes, fields: dict[str, str]) -> tuple[int | None, str | None]:
    """Bytes and SHA-1 of the full payload: computed for a response, as noted for a revisit."""
    if fields.get("warc-type") == "revisit":
        return int(fields.get("x-payload-length") or 0), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return len(payload), hashlib.sha1(payload).hexdigest()


def _candidates(stretch: int):
    """From rows (file, block, piece) in file order, the candidates of each stretch when it ends."""
    names = [x.split()[0] for x in CANDIDATE.split(", ")]

    def followed(rows: list[list]) -> Iterator[pa.RecordBatch]:
        # Chains within the stretch, last candidate first. A record's magic stands len(MAGIC) before its piece.
        at = {r[4] - len(MAGIC): i for i, r in enumerate(rows) if r[3] or r[1]}
        edge = rows[-1][4] + rows[-1][5]
        for r in reversed(rows):
            if r[6] is not None:
                r[7] = rows[at[r[6]]][7] if r[6] in at else r[6] if r[6] >= edge else None
        for s in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(c, t) for n, c, t in zip(names, zip(*rows[s : s + 20_000], strict=True), TYPES, strict=True)}
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, rel, idx = None, [], 0, 0
        for batch in batches:
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and ((file, block) != split or rel // stretch != rows[0][2]):
                    yield from followed(rows)
                    rows = []
                if (file, block) != split:
                    split, rel, idx = (file, block), 0, 0
                size, fields = header_of(piece)
                length = fields.get("content-length", "")
                row = [file, block, rel // stretch, idx, rel, len(piece), None, None, False, None, None, None, None, None, None]
                if size and length.isdigit() and (idx or block):  # what stands before a file's first magic is no record
                    row[6] = rel + size + int(length) + len(BLANK)
                    row[8] = row[6] == rel + len(piece)
                    row[9:13] = fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to")
                    if row[8]:
                        row[13:15] = describe(piece[size : size + int(length)], fields)
                rows.append(row)
                rel += len(piece) + len(MAGIC)
                idx += 1
        if rows:
            yield from followed(rows)

    return run


TYPES = [pa.string(), *[pa.int64()] * 7, pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string()]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Of a stretch's candidates, those on the chain from its entry."""
    group = group.sort_values("start")
    at, entry = dict(zip(group["start"], group["next"], strict=True)), group.loc[group["entry"], "start"]
    kept, now = [], entry.iloc[0] if len(entry) else None
    while now in at:
        kept.append(now)
        now = at[now]
    return pd.DataFrame({"file": group["file"].iloc[0], "start": kept}).astype({"start": "int64"})


def reached(chain: DataFrame) -> DataFrame:
    """(file, start) of the candidates at which a stretch is entered on the way from the start of its file. The pointers'
    reach doubles with every round, so there are as many rounds as a file's stretches have binary digits."""
    jumps = chain.where("leaves is not null").select("file", "start", F.col("leaves").alias("to"))
    entries, size = written(chain.select("file").distinct().withColumn("start", F.lit(0).cast("bigint")), "warc-entries"), -1
    while (now := entries.count()) != size:
        size = now
        more = entries.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        entries = written(entries.unionByName(more).distinct(), "warc-entries")
        further = jumps.select(F.col("file"), F.col("start").alias("to"), F.col("to").alias("end"))
        jumps = written(jumps.join(further, ["file", "to"], "left").select("file", "start", F.coalesce("end", "to").alias("to")), "warc-jumps")
    return entries


def read_archives(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """One row per record: file, start, type, record, uri, refers, payload_bytes, payload_digest."""
    found = written(pieces(spark, path).mapInArrow(_candidates(stretch), CANDIDATE), "warc-candidates")
    splits = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    absolute = lambda c, back=0: (F.col(c) + F.col("base") - back).alias
    chain = found.join(splits, ["file", "block"]).where("next is not null")
    chain = chain.select(
        "file", "block", "stretch", "idx", absolute("rel", len(MAGIC))("start"), absolute("next")("next"), absolute("leaves")("leaves"), "complete", "type", "record", "uri", "refers", "payload_bytes", "payload_digest",
    )
    chain = written(chain, "warc-chain")
    marked = chain.join(reached(chain).withColumn("entry", F.lit(True)), ["file", "start"], "left")
    marked = marked.select("file", "block", "stretch", "start", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    kept = marked.groupBy("file", "block", "stretch").applyInPandas(_walk, "file string, start bigint")
    records = written(chain.join(kept, ["file", "start"]), "warc-records")
    cut = records.where("not complete").select("file", "block", "stretch", "start", "next")
    whole = records.where("complete").drop("block", "stretch", "idx", "next", "leaves", "complete")
    if not cut.limit(1).count():
        return whole
    return whole.unionByName(_joined(spark, path, cut, found.join(splits, ["file", "block"]), absolute))


def _joined(spark: SparkSession, path: str, cut: DataFrame, found: DataFrame, absolute) -> DataFrame:
    """Records whose payload holds the magic, from all pieces between their start and their successor."""
    places = found.select("file", "block", "stretch", "idx", absolute("rel", len(MAGIC))("at"))
    # Records don't overlap: a piece belongs to the last record that starts at or before it, in its stretch or before that.
    key, none = ["file", "block", "stretch"], lambda c: F.lit(None).cast("bigint").alias(c)
    both = places.join(F.broadcast(cut.select("file").distinct()) if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cut.select("file").distinct(), "file", "left_semi")
    both = both.select(*key, "idx", "at", none("start"), none("next")).unionByName(cut.select(*key, none("idx"), F.col("start").alias("at"), "start", "next"))
    ends = both.groupBy(*key).agg(F.max_by(F.struct("start", "next"), "start").alias("end"))
    ends = ends.select(*key, F.last("end", True).over(Window.partitionBy("file").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
    last = Window.partitionBy(*key).orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumns({"start": F.last("start", True).over(last), "next": F.last("next", True).over(last)}).join(ends, key)
    held = held.withColumns({"start": F.coalesce("start", "end.start"), "next": F.coalesce("next", "end.next")})
    held = held.where("idx is not null and start is not null and at < next").select("file", "block", "idx", "at", "start")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            idx = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split, n = (key, 0) if key != split else (split, n + 1)
                idx.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(idx, pa.int64())], ["file", "block", "piece", "idx"])

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, start, parts in zip(frame["file"], frame["start"], frame["parts"], strict=True):
                data = MAGIC.encode().join(bytes(p["piece"]) for p in parts)
                size, fields = header_of(data)
                n, digest = describe(data[size : size + int(fields["content-length"])], fields)
                out.append((file, start, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), n, digest))
            yield pd.DataFrame(out, columns=["file", "start", "type", "record", "uri", "refers", "payload_bytes", "payload_digest"])

    rows = pieces(spark, path).mapInArrow(number, "file string, block bigint, piece binary, idx bigint").join(held, ["file", "block", "idx"])
    rows = rows.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    return rows.mapInPandas(join, "file string, start bigint, type string, record string, uri string, refers string, payload_bytes bigint, payload_digest string")


def page_number(record: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({record}, 'urn:page:([^>]*)>', 1) as bigint)")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
