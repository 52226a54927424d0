"""Benchmark decontamination: which documents contain a test item (DataFrame operations only).

Size-partitioned MinHash containment search. Items are partitioned by the number q of their distinct five-word shingles:
partition c has those with 2**(c-1) < q <= 2**c. It has a width of its own, floor((1 - t) * 2**c) + 1, and gives each of
its items so many smallest shingle hashes as its MinHash sketch; and it has a least size of documents, t times its smallest
q, below which a document can't hold any of its items. A document that holds at least t * q of an item's shingles lacks at
most (1 - t) * q of them, fewer than the width, so it must hold one of the sketch: the search has full recall, where
symmetric MinHash between a short item and a long document would need thousands of rows. A document's shingles are looked
up in those partitions that it is long enough for. Candidates are then verified by exact containment of the
shingle texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 5
THRESHOLD = 0.8
#: Sketch rows (40 bytes each) that are broadcast; more are shuffled by their hash.
BROADCAST_ROWS = 1_000_000
#: Shares of documents for each of which a shuffled sketch row is repeated, so that a popular shingle isn't one task's.
SALTS = 16


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that punctuation and spacing round a passage don't hide it."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_texts(words: Column, width: int = WIDTH) -> Column:
    """Distinct shingles of a word array as text; fewer words: all of them as one; none: no shingle."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(width))))
        one = F.filter(F.array(F.concat_ws(" ", w)), lambda x: x != "")
        return F.array_distinct(F.when(F.size(w) >= width, many).otherwise(one))

    return bound(words, of)


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of a word array's shingles, repeats included; a shingle's hash is that of its words' hashes."""

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        one = F.array(F.xxhash64(F.to_json(h)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= width, many).when((F.size(h) == 1) & (F.get(h, F.lit(0)) == F.xxhash64(F.lit(""))), none).otherwise(one)

    return bound(F.transform(words, lambda x: F.xxhash64(x)), of)


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """item_id, q, the item's partition (size_class), the least shingles of a document there, and a row for each hash of the
    sketch, whose width is that of the partition."""
    rows = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(words_of(F.col("text")), width))).alias("distinct"))
    rows = rows.withColumn("q", F.size("distinct")).where("q > 0").withColumn("size_class", F.ceil(F.log2("q")).cast("int"))
    smallest = F.when(F.col("size_class") == 0, 1).otherwise(F.pow(F.lit(2.0), F.col("size_class") - 1) + 1)
    rows = rows.withColumn("least", F.ceil(threshold * smallest - 1e-9).cast("int"))
    rows = rows.withColumn("k", F.floor((1 - threshold) * F.pow(F.lit(2.0), "size_class") + 1e-9).cast("int") + 1)
    return rows.select("item_id", "q", "size_class", "least", F.explode(F.slice("distinct", 1, F.col("k"))).alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame, threshold: float, width: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id) of documents that hold a hash of an item's sketch and are long enough for the item.

    Documents are read and hashed once. A sketch of up to ``rows`` rows is broadcast; a larger one is shuffled, and so are the
    distinct hashes of each document, under salts of the documents.
    """
    total, least = sketch.agg(F.count("*"), F.coalesce(F.min("least"), F.lit(1))).first()
    own = docs.select("doc_id", shingle_hashes(words_of(F.col("text")), width).alias("hashes")).where(F.size("hashes") >= least)
    own = own.withColumn("n", F.size("hashes"))
    keys = sketch.select("hash", "size_class", "least").distinct()
    if total <= rows:
        hits = own.select("doc_id", "n", F.explode("hashes").alias("hash")).join(F.broadcast(keys), "hash")
        part = F.broadcast(sketch)
    else:
        own = own.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).alias("salt"), F.explode(F.array_distinct("hashes")).alias("hash"))
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        hits, part = own.join(keys, ["hash", "salt"]), sketch
    hits = hits.where("n >= least").select("doc_id", "n", "size_class", "hash").distinct()
    found = hits.join(part, ["size_class", "hash"]).where(f"n >= {threshold} * q - 1e-9")
    return found.select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shared, n_item, containment.

    Null and empty texts have no shingles and match nothing. Texts of fewer than ``width`` words have all their words as
    one shingle, so such an item is found only in a document that consists of it. Rows that repeat an id count as one
    document or item with the shingles of each row tested apart. Texts are read whole, however long. Only doc_id, item_id
    and text are read.
    """
    items = items.select("item_id", "text").distinct()
    sketch = written(item_sketches(items, threshold, width), "sketches")
    pairs = written(candidates(docs, sketch, threshold, width), "candidates")
    texts = docs.select("doc_id", "text").join(pairs, "doc_id")
    wanted = items.select("item_id", shingle_texts(words_of(F.col("text")), width).alias("wanted"))
    pairs = texts.join(wanted, "item_id").withColumn("n_item", F.size("wanted"))
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect(F.col("wanted"), shingle_texts(words_of(F.col("text")), width))))
    pairs = pairs.where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    figures = F.struct(
        (F.col("n_shared") / F.col("n_item")).alias("containment"), F.col("n_shared").cast("bigint").alias("n_shared"), F.col("n_item").cast("bigint").alias("n_item")
    )
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(figures).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_item", "x.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, in the columns of ``docs``; rows without a doc_id stay unless an equal id matched."""
    bad = contained_items(docs, items, threshold).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
