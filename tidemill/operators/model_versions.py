"""Versions of a model on storage, and a watch on how far what it sees has drifted from what it was fitted on.

A version is a folder: the model as JSON and, for each of its columns, how many training rows fell into each cell. Counts
merge by addition, so those of a stream's triggers are summed, and the index follows from the sums.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted

COUNTS = "column string, cell int, n bigint"


def counted(model: Boosted, rows: DataFrame) -> DataFrame:
    """``column, cell, n``: rows by the cell of each of the model's columns."""
    named = F.arrays_zip(F.array(*map(F.lit, model.columns)).alias("c"), F.col("_codes").alias("e"))
    cells = model.coded(rows).select(F.explode(named).alias("x")).select(F.col("x")["c"].alias("column"), F.col("x")["e"].alias("cell"))
    return cells.groupBy("column", "cell").agg(F.count("*").alias("n"))


def versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(m[1]) for m in (re.fullmatch(r"v=(\d+)", n) for n in names) if m)


def save(spark: SparkSession, root: str, model: Boosted, train: DataFrame) -> int:
    """A new version of the model; its number. The counts go first: a version without a model isn't one."""
    number = max(versions(spark, root), default=0) + 1
    counted(model, train).write.parquet(f"{root}/v={number}/counts")
    model.save(spark, f"{root}/v={number}/model")
    return number


def load(spark: SparkSession, root: str, number: int | None = None) -> tuple[Boosted, DataFrame, int]:
    """The model, its training counts and its number; the last version if none is named. A ValueError if there is none."""
    known = versions(spark, root)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no such version below {root}: {number}")
    number = number or known[-1]
    return Boosted.load(spark, f"{root}/v={number}/model"), spark.read.schema(COUNTS).parquet(f"{root}/v={number}/counts"), number


def psi(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``feature, psi`` from two tables of counts, which may have several rows for a cell (one a trigger)."""
    sides = []
    for name, counts in (("e", expected), ("a", actual)):
        n = counts.groupBy("column", "cell").agg(F.sum("n").alias("_n"))
        total = n.groupBy("column").agg(F.sum("_n").alias("_all"))
        sides.append(n.join(total, "column").select("column", "cell", (F.col("_n") / F.col("_all")).alias(name)))
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("e", "a"))
    both = sides[0].join(sides[1], ["column", "cell"], "full")
    return both.groupBy(F.col("column").alias("feature")).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
