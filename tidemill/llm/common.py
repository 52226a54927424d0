"""Pieces that several corpus operators share: reading, normal forms, the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case, every other byte as it is.
LOWER_BYTES = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

#: Rows and bytes of documents handed to Python at once; a batch ends at whichever comes first, so it holds more than
#: ARROW_BYTES only where a single text does.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20
#: A key with a thousandth of all rows or more is one of a thousand at most.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch of whole texts. Spark reads these settings of the session when a
    plan runs, so they stay set; smaller ones of the user are left alone."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary one, and a cluster an error, as its machines would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_space(text: Column) -> Column:
    """Null to empty, every run of ``[\\x20\\x09-\\x0D]`` to one space (single spaces need no replacement)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, remainder 1; a row without an id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and in ``weight`` its number of rows.

    Keys of a thousandth of all ``total`` rows or more are a thousand at most: the table's rows for them are broadcast.
    Only the others are brought together by their key, so no task gets a hot one. ``key`` must not be null.
    """
    if total < HOT_SHARE:
        return rows.join(table, key)
    more, salt = [c for c in table.columns if c != key], "_salt" + key
    hot = table.where(F.col(weight) * HOT_SHARE >= total).select(key, *[F.col(c).alias("_hot" + c) for c in more])
    cold = table.where(F.col(weight) * HOT_SHARE < total).withColumn(salt, F.lit(0))
    out = rows.join(F.broadcast(hot), key, "left")
    # Rows that are served go through the shuffle under salts, which no row of the table has, and so evenly.
    out = out.withColumn(salt, F.when(F.col("_hot" + weight).isNull(), 0).otherwise(1 + F.spark_partition_id() % 1009))
    return out.join(cold, [key, salt], "left").select(*rows.columns, *[F.coalesce("_hot" + c, c).alias(c) for c in more])


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, root) per linked node, root its smallest node.

    Alternates large-star and small-star steps until the set of links stands still. Links are kept as a set of
    (larger, smaller) pairs in the shared folder between rounds; hubs only meet in aggregates with map-side minima
    and in joins that adaptive execution can split. A hash of the set tells that it may stand still; that it does is
    decided by the pairs themselves.
    """
    pairs = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")
        )
        before, pairs = pairs, written(small.select("p.a", "p.b").where("a <> b").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state and not pairs.join(before, ["a", "b"], "left_anti").limit(1).count():  # as many, and none is new
            break
        state = now
    return pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
