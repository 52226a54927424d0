"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit i of a 64-bit fingerprint has a vector m(i) of four bits, not zero; table v (1 to 15) looks at the bits with
<m(i), v> = 1 over GF(2). Up to three differing bits span at most three of the four dimensions, so some v is orthogonal
to all of them, and the pair agrees on everything that table v looks at: every pair within the radius meets in a table.

Buckets are read in sorted order as a stream. One of at most ``most`` fingerprints is compared in full and yields a
spanning forest of its links. A larger one is passed on whole to a join of Hamming balls whose size is linear in the
bucket: within a table's bucket only the bits that it does not look at can differ, each member lays its ball of radius
two over those bits, and wherever a ball's centre ring (radius one) meets, all members that reach the point are linked
to its smallest inner member. Inner members are within two of each other and outer ones within three, so each link is
sound; a pair at distance three has such a point one step from one and two from the other, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, joined, small_batches, written

RADIUS = 3
SHINGLE = 3
SEED = 42
MOST = 512
#: Vectors m(i) of the bits: 1 to 15 in turn.
VECTORS = [i % 15 + 1 for i in range(64)]
MASKS = [sum(1 << i for i in range(64) if (VECTORS[i] & v).bit_count() % 2) for v in range(1, 16)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles: lower-case A-Z, words between ASCII white space."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh64_digest, SEED
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    raw = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[at : at + 8192], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [signed(fingerprint(x.as_py())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every row; null and blank texts have fp 0."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of the given fingerprints within the radius."""
    open_, out = np.ones(len(bits), bool), []
    for i in range(len(bits)):
        if not open_[i]:
            continue
        open_[i], queue = False, [i]
        while queue:
            own = queue.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(bits ^ bits[own]) <= radius))
            open_[near] = False
            queue += near.tolist()
            out += [(int(bits[j]), int(bits[own])) for j in near]
    return out


def _bucket_links(most: int):
    """Streams rows (t, k, fp) sorted by t and k; keeps at most ``most`` + one batch of them."""

    def rows(kind: str, found: list | np.ndarray, t: int, k: int) -> pa.RecordBatch:
        a = np.array([x[0] for x in found], np.uint64) if kind == "link" else found
        b = np.array([x[1] for x in found], np.uint64) if kind == "link" else np.full(len(found), 0, np.uint64)
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind == "hot"] * n), pa.array([t] * n, pa.int32()), pa.array([k] * n, pa.int64()), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.view(np.int64))],
            ["hot", "t", "k", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot, links = None, np.empty(0, np.uint64), False, []

        def close():
            if len(held) > 1 and not hot:
                links.extend(_forest(held, RADIUS))

        for batch in batches:
            t, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            bits = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            for s, e in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(t)])).tolist(), strict=True):
                if e == s:
                    continue
                now = (int(t[s]), int(k[s]))
                if now != key:
                    close()
                    key, held, hot = now, np.empty(0, np.uint64), False
                if e - s == 1 and not len(held) and e < len(t):
                    held = bits[s:e]
                    continue
                held = np.concatenate((held, bits[s:e]))
                if hot or len(held) > most:
                    hot = True
                    yield rows("hot", held, *key)
                    held = np.empty(0, np.uint64)
            if len(links) > 4096:
                yield rows("link", links, 0, 0)
                links.clear()
        close()
        if links:
            yield rows("link", links, 0, 0)

    return run


def near_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Links a, b between distinct fingerprints ``fp`` whose closure is that of all pairs within three bits."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(MASKS)])
    laid = fps.select(F.explode(keys).alias("x"), "fp").select("x.t", "x.k", "fp")
    laid = laid.repartition("t", "k").sortWithinPartitions("t", "k")
    found = written(laid.mapInArrow(_bucket_links(most), "hot boolean, t int, k bigint, a bigint, b bigint"), "buckets")
    links = found.where("not hot").select("a", "b")
    if found.where("hot").limit(1).count():
        links = links.unionByName(_ball_links(found.where("hot").select("t", F.col("a").alias("fp"))))
    return links


def _ball_links(members: DataFrame) -> DataFrame:
    """The exact way for large buckets: rows are linear in the members (466 at most for each)."""
    free = [[1 << i for i in range(64) if not m >> i & 1] for m in MASKS]
    inner = [[0, *f] for f in free]
    outer = [[x | y for n, x in enumerate(f) for y in f[n + 1 :]] for f in free]
    ball = [(t, signed(x), ring) for t in range(len(MASKS)) for ring, xs in ((0, inner[t]), (1, outer[t])) for x in xs]
    points = members.sparkSession.createDataFrame(ball, "t int, x bigint, far int")
    rows = members.join(F.broadcast(points), "t").select("t", "fp", "far", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    least = rows.where("far = 0").groupBy("t", "z").agg(F.min("fp").alias("b"))
    return rows.join(least, ["t", "z"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row.

    Null and blank texts share fingerprint zero and link like any other; repeated rows share a fingerprint; a row
    without an id takes the component of its fingerprint, which is null if no row of the component has an id. Texts are
    read whole, however long. An empty table gives an empty result; only doc_id and text are read.
    """
    prints = written(fingerprints(docs), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct-fingerprints")
    nodes = components(near_links(fps.select("fp"), most))
    linked = nodes.join(fps, nodes["node"] == fps["fp"]).select("fp", "root", "rep")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    linked = linked.join(lowest, "root").select("fp", "low")
    named = written(fps.join(linked, "fp", "left").select("fp", "copies", F.coalesce("low", "rep").alias("component_id")), "named")
    out = joined(prints, named, "fp", "copies", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows that represent their component, in the columns of ``docs`` (rows without an id stay)."""
    other = near_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(other, "doc_id", "left_anti")
