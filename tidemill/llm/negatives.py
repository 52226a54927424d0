"""Hard-negative mining: threshold joins of anchors with all rows, in the manner of L2AP, exact.

Vectors become integers (floor of 256 times a component), so that scores are exact. A *block* of rows gets an inverted
index: dimensions are put in order of their weight in the block, and a row's lightest dimensions stay out of the index as
long as a bound says that they alone can't reach the threshold: the norm of the row's part times that of an anchor's. Rows
are sorted by how many they leave out, so a dimension's posting list is a run of rows and scores accumulate by runs. After
each stretch of dimensions those pairs go whose partial score plus the product of the remaining norms stays below the
anchor's threshold; the pairs left are scored in full. A search begins with a high threshold and lowers it for those
anchors whose windows aren't full yet; once they are, the lowest score in a window is the threshold for all blocks to come.

Two such joins: the best rows of an anchor's own label (its positives), then for each positive the best rows of other
labels within a window of scores. Rows are dealt to tasks by files, not by label or vector, so neither a hot label nor many
copies of a vector meet in one task. A task keeps as many rows an anchor (and positive) as are asked for; those of all tasks
are merged by a ranking that Spark does before and after its shuffle. Anchors are a stated query set: they are read in
blocks of bounded size, each of which is broadcast and joined with all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Rows that are indexed together.
BLOCK_ROWS = 4096
#: Bytes of vectors of one block of anchors, which is broadcast; a block has ANCHORS anchors at most.
ANCHORS, ANCHOR_BYTES = 1024, 16 << 20
#: Prunings on the way through all dimensions, and the share of pairs below which the rest is scored pair by pair.
PRUNINGS, FEW = 8, 0.05
#: Products of norms up to here make every partial sum an exact float.
EXACT = float(1 << 52)
#: Thresholds of a first search, as shares of the way from the highest possible score to the lowest wanted one.
STEPS = (0.25, 0.3, 0.35, 0.4, 0.5, 1.0)


@dataclass(frozen=True)
class Mining:
    """positives: rows taken for an anchor; negatives: for a positive; a negative's score lies between ``low`` and ``high``
    hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


# ---- one block of rows against one block of anchors (numpy) ----


class Index:
    """The inverted index of a block of integer rows for anchors whose scores must reach ``bars`` (one for each anchor)."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, bars: np.ndarray):
        self.dims = np.argsort((rows * rows).sum(0), kind="stable")  # the lightest first
        y, x = rows[:, self.dims], anchors[:, self.dims]
        self.y_before, self.x_before = _norms(y), _norms(x)
        # A row may leave out its first c dimensions if |row part| * |anchor part| stays below the bar for every anchor.
        with np.errstate(divide="ignore", invalid="ignore"):
            worst = np.where(bars[:, None] > 0, self.x_before / bars[:, None], np.where(self.x_before > 0, np.inf, 0.0)).max(0) if len(bars) else np.zeros(x.shape[1] + 1)
            worst[0] = 0.0
            reach = self.y_before * worst
        reach = np.where(np.isnan(reach), np.inf, reach)
        out = (reach < 1 - 1e-9).sum(1) - 1 if np.all(bars > 0) else np.zeros(len(y), int)
        self.order = np.argsort(out, kind="stable")
        self.left_out = out[self.order]
        self.y, self.x = y[self.order], x
        self.y_before = self.y_before[self.order]
        self.indexed = np.where(np.arange(y.shape[1]) >= self.left_out[:, None], self.y, 0.0)

    def pairs(self, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row (both by place) and score of all pairs that reach the anchor's bar."""
        at, n = self.y.shape[1], len(self.y)
        stretch = -(-at // PRUNINGS)
        sums, alive = np.zeros((len(self.x), n)), np.ones((len(self.x), n), bool)
        while at > 0:
            begin = max(0, at - stretch)
            run = int(np.searchsorted(self.left_out, at - 1, side="right"))  # rows that index any of these dimensions
            if run:
                sums[:, :run] += self.x[:, begin:at] @ self.indexed[:run, begin:at].T
            at = begin
            # What is missing: the dimensions before ``at``, and for rows that left out more, all that they left out.
            rest = np.maximum(at, self.left_out)
            bound = self.x_before[:, rest] * np.take_along_axis(self.y_before, rest[:, None], 1)[:, 0]
            alive &= sums + bound * (1 + 1e-9) + 1e-6 >= bars[:, None]
            if alive.mean() <= FEW or at <= self.left_out[0]:
                break
        a, r = np.nonzero(alive)
        score = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", self.x[a[i : i + (1 << 16)]], self.y[r[i : i + (1 << 16)]])
        hit = score >= bars[a]
        return a[hit], self.order[r[hit]], score[hit]


def _norms(x: np.ndarray) -> np.ndarray:
    """norm of the first 0, 1, ... components of each row."""
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, 1)], 1))


class Best:
    """The best rows so far in windows of scores; each window belongs to an anchor.

    owner: the anchor (place) of each window; low, high: least and highest score; k: rows of a full window.
    """

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, anchors: int):
        self.owner, self.low, self.high, self.k, self.anchors = owner, low, high, k, anchors
        self.window, self.score, self.id = np.empty(0, int), np.empty(0), np.empty(0, np.int64)
        self.begin = np.searchsorted(owner, np.arange(anchors), "left")
        self.count = np.searchsorted(owner, np.arange(anchors), "right") - self.begin

    def floors(self) -> np.ndarray:
        """The score that a row must reach to enter each window: the window's low until it is full, then its k-th."""
        out = self.low.astype(float).copy()
        full = np.flatnonzero(np.bincount(self.window, minlength=len(out)) >= self.k)
        if len(full):
            worst = np.full(len(out), np.inf)
            np.minimum.at(worst, self.window, self.score)
            out[full] = np.maximum(out[full], worst[full])
        return out

    def missing(self) -> np.ndarray:
        """Which windows aren't full."""
        return np.bincount(self.window, minlength=len(self.owner)) < self.k

    def bars(self, floors: np.ndarray) -> np.ndarray:
        """The lowest floor of each anchor's windows; no row reaches the bar of an anchor without any."""
        out = np.full(self.anchors, np.inf)
        np.minimum.at(out, self.owner, floors)
        return out

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        n = self.count[anchor]
        at = np.repeat(np.arange(len(anchor)), n)
        window = self.begin[anchor][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        fits = (score[at] >= self.low[window]) & (score[at] <= self.high[window])
        at, window = at[fits], window[fits]
        w, s, i = np.concatenate([self.window, window]), np.concatenate([self.score, score[at]]), np.concatenate([self.id, ids[at]])
        order = np.lexsort((i, -s, w))
        w = w[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w, "left")
        order = order[rank < self.k]
        self.window, self.score, self.id = w[rank < self.k], s[order], i[order]


def search(best: Best, anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, fits) -> None:
    """Enter the rows of a block into the windows. ``fits(anchor, row)`` tells which pairs (by place) may enter.

    Windows that lack rows are searched with falling thresholds: a step that brings in enough ends the search for its
    anchor. The windows that are full already, and those that are then, need no row below their floor.
    """
    if not len(rows) or not len(best.owner):
        return
    top = np.minimum(best.high, _norms(anchors)[best.owner, -1] * _norms(rows)[:, -1].max(initial=0))
    floors, done = best.floors(), np.zeros(len(best.owner), bool)
    seen = np.full(best.anchors, np.inf)  # scores from here on have been entered
    for share in STEPS:
        lowest = np.where(np.isfinite(floors), floors, -top)
        wanted = np.where(best.missing() & (share < 1), top + (lowest - top) * share, floors)
        wanted = np.where(done, np.inf, np.maximum(wanted, floors))
        bars = best.bars(wanted)
        todo = np.flatnonzero(bars < seen)
        if not len(todo):
            break
        a, r, score = Index(rows, anchors[todo], bars[todo]).pairs(bars[todo])
        a = todo[a]
        new = (score < seen[a]) & fits(a, r)
        best.add(a[new], score[new], ids[r[new]])
        seen[todo] = bars[todo]
        floors = best.floors()
        done = seen[best.owner] <= floors


# ---- over Spark ----


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, units`` (integer components as doubles) of the rows that take part."""
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & whole)
    label = F.col("label").cast("bigint")
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("units"),
    )


def _matrix(units, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter ones end in zeros."""
    out = np.zeros((len(units), width))
    lengths = pa.compute.list_value_length(units).to_numpy(zero_copy_only=False).astype(int)
    flat = units.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(units)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, id, label and vectors of BLOCK_ROWS rows at a time."""
    kept, n = [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(begin, BLOCK_ROWS)
            if n + part.num_rows > BLOCK_ROWS and kept:
                yield _block(kept, width)
                kept, n = [], 0
            kept.append(part)
            n += part.num_rows
    if n:
        yield _block(kept, width)


def _block(parts: list[pa.RecordBatch], width: int):
    whole = pa.Table.from_batches(parts).combine_chunks()
    number = lambda c: whole[c].to_numpy().astype(np.int64)
    return number("_row"), number("vec_id"), number("label"), _matrix(whole["units"].combine_chunks(), width)


def _join(rows: DataFrame, anchors: dict, windows: dict, k: int, same_label: bool) -> DataFrame:
    """For each window the best ``k`` rows of each task: ``window, score, id``."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = shared.value
        best = Best(windows["owner"], windows["low"], windows["high"], k, len(anchors["row"]))
        for number, ids, labels, vectors in _blocks(batches, anchors["units"].shape[1]):
            def fits(a, r, number=number, labels=labels):
                same = anchors["label"][a] == labels[r]
                return same & (anchors["row"][a] != number[r]) if same_label else ~same

            search(best, anchors["units"], vectors, ids, fits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.window, pa.int64()), pa.array(best.score.astype(np.int64)), pa.array(best.id, pa.int64())], ["window", "score", "id"]
        )

    found = rows.mapInArrow(scan, "window bigint, score bigint, id bigint")
    place = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor_every: int = 100, mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, one row for each negative.

    rows: ``vec_id, label, embedding``. Rows with a null id, label or vector, or a component that is null or not finite,
    take no part. Vectors of unequal length are compared as if the shorter ended in zeros; an empty one scores 0 with
    all. Rows that repeat an id are rows of their own, an anchor that repeats has its results twice. Equal scores are
    ordered by id. A positive with a score below 0 has no negatives, as its window is empty; one that scores 0 has those
    that score 0. No rows or no anchors give no result. Other columns are not looked at. Vectors whose scores may pass
    2**52 raise a ValueError, as they would not be exact.
    """
    numbered = written(usable(rows).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    spark = rows.sparkSession
    facts = numbered.agg(F.max(F.size("units")).alias("width"), F.max(F.aggregate("units", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if facts.width is None:
        return spark.createDataFrame([], schema)
    if facts.most > EXACT:
        raise ValueError("vectors are too long for exact scores")
    width = max(1, facts.width)
    most = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * width)))
    asked = written(numbered.where(F.col("vec_id") % anchor_every == 0), "anchors")
    blocks = -(-asked.count() // most)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for n in range(blocks):
        found = asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == n).collect()  # about ``most`` rows
        for begin in range(0, len(found), most):
            _mined(numbered, _arrays(found[begin : begin + most], width), mining).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def _arrays(rows: list, width: int) -> dict:
    """A block of anchors in arrays."""
    units = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        units[i, : len(r.units)] = r.units
    number = lambda c: np.array([r[c] for r in rows], np.int64)
    return {"row": number("_row"), "id": number("vec_id"), "label": number("label"), "units": units}


def _mined(rows: DataFrame, anchors: dict, mining: Mining) -> DataFrame:
    n, spark = len(anchors["row"]), rows.sparkSession
    everything = {"owner": np.arange(n), "low": np.full(n, -np.inf), "high": np.full(n, np.inf)}
    found = _join(rows, anchors, everything, mining.positives, True).toPandas()  # ``positives`` rows for an anchor of the block
    found = found.sort_values(["window", "rank"])
    # 100 * negative lies between low * positive and high * positive; scores are integers.
    low, high = -(-found["score"] * mining.low // 100), found["score"] * mining.high // 100
    open_ = (low <= high).to_numpy()
    found, low, high = found[open_], low[open_].to_numpy(float), high[open_].to_numpy(float)
    windows = {"owner": found["window"].to_numpy(np.int64), "low": low, "high": high}
    pairs = pd.DataFrame({"window": np.arange(len(found)), "anchor_id": anchors["id"][windows["owner"]], "positive_id": found["id"].to_numpy(), "positive_score": found["score"].to_numpy()})
    named = F.broadcast(spark.createDataFrame(pairs, "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint"))  # as many as the block's positives
    negatives = _join(rows, anchors, windows, mining.negatives, False)
    return negatives.join(named, "window").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
