"""Exact deduplication by skew-safe combining.

Texts are reduced in three steps, each of which compares the full normalised text as well as its digest: within a
task (map-side combine), within salted digest groups, and over the salt winners of a digest. A group of copies that
holds a third of all rows therefore reaches a shuffle as at most one row per task, and its salted groups as at most
tasks/salts rows each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, joined, one_space, written

SALTS = 8


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def text_classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: _digest, _text, keep_id, group_size."""
    rows = docs.select("doc_id", one_space(F.col("text")).alias("_text")).select("doc_id", "_text", digest(F.col("_text")).alias("_digest"))
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.groupBy("_digest", "_text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _classed(docs: DataFrame, digest: Callable[[Column], Column], salts: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with digest, keep_id and group_size under names that ``docs`` doesn't have, and these names."""
    names = tuple(free_name(docs, x) for x in ("_digest", "_keep", "_size"))
    classes = text_classes(docs, digest, salts).select("_digest", "keep_id", "group_size")
    classes = written(classes.toDF(*names), "text-classes")
    d, k, n = names
    clashing = classes.groupBy(d).count().where("count > 1").select(d)
    members = docs.withColumn(d, digest(one_space(F.col("text"))))
    total = classes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if not clashing.limit(1).count():
        return joined(members, classes, d, n, total), names
    sound = classes.join(clashing, d, "left_anti")
    text = free_name(docs, "_text")
    again = members.withColumn(text, one_space(F.col("text"))).join(clashing, d, "left_semi")
    found = again.groupBy(d, text).agg(F.min("doc_id").alias(k), F.count("*").alias(n))
    return joined(members, sound, d, n, total).unionByName(again.join(found, [d, text]).drop(text)), names


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, salts: int = SALTS) -> DataFrame:
    """Every input column plus text_digest, keep_id, group_size and kept.

    * Null texts count as empty; texts are equal when identical after ``one_space``, however long they are.
    * The row with the smallest doc_id of a group stays. Rows that repeat doc_id and text are one document and share
      its verdict. Rows without a doc_id never stay unless their whole group has none (keep_id is then null).
    * Input columns named like an output are left out. An empty table gives an empty result.
    * Digests that stand for two different texts are found in the class table and resolved on the texts themselves.
    """
    out, (d, k, n) = _classed(docs, digest, salts)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text_digest", "keep_id", "group_size", "kept")]
    return out.select(*own, F.col(d).alias("text_digest"), F.col(k).alias("keep_id"), F.col(n).alias("group_size"), F.col("doc_id").eqNullSafe(F.col(k)).alias("kept"))


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the columns of ``docs`` and their own values; of rows that repeat an id and a text one is
    kept. Nulls, empty and long texts, ties and empty tables are as in ``exact_groups``."""
    out, (d, k, _) = _classed(docs, sha256_hex, salts)
    kept = out.where(F.col("doc_id").eqNullSafe(F.col(k)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(k))
    if not repeated.limit(1).count():
        return kept.select(*own)
    ids = written(repeated, "repeated-ids").withColumnRenamed(k, "_id" + k)
    same = F.col("doc_id").eqNullSafe(F.col("_id" + k))
    again = kept.join(ids, same, "left_semi").dropDuplicates(["doc_id", d])
    return kept.join(ids, same, "left_anti").unionByName(again).select(*own)
