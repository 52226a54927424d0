"""Boosted trees for several classes: one softmax loss, histograms of gradients summed over the cluster, a pass a level.

Columns become codes of at most ``bins`` quantile cells, once. A pass over the coded rows adds up, for each class, node,
column and cell, the gradients and second derivatives of the rows there; the driver gets these sums (their number doesn't
depend on the rows), splits every node of a level in all classes' trees, and hands the trees to the next pass. Gradients
are whole multiples of 2**-24, so sums are exact and a fit is the same however rows are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import quantiles
from ..sources.shared import stored

#: Steps of a gradient, and rounds after which the rows' scores so far are stored.
STEPS, STORE_EVERY = float(1 << 24), 10


@dataclass(frozen=True)
class Shape:
    """rounds: trees of each class; rate: share of a leaf's value that is added; l2: added to a leaf's second derivative;
    least_weight: second derivative of a leaf, at least; rows_share, columns_share: drawn for each round and tree."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    bins: int = 32
    least_weight: float = 1.0
    rows_share: float = 1.0
    columns_share: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """A full binary tree; node n has the children 2n + 1 and 2n + 2. A row goes right if its code is above ``cell``; a
    node that isn't split sends all to the left."""

    column: np.ndarray
    cell: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        return Tree(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 30), np.zeros(2**depth))

    def node(self, codes: np.ndarray, level: int) -> np.ndarray:
        """The place of each row within its level."""
        at = np.zeros(len(codes), np.int64)
        for _ in range(level):
            at = 2 * at + 1 + (codes[np.arange(len(codes)), self.column[at]] > self.cell[at])
        return at - (2**level - 1)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.leaf[self.node(codes, int(np.log2(len(self.leaf))))]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def drawn(ids: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Which rows a round reads: a hash of row, seed and round below the share."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xBF58476D1CE4E5B9) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2**64 - 1))


def whole_gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(scores)
    g = p - (labels[:, None] == np.arange(p.shape[1]))
    return np.rint(g * STEPS), np.rint(p * (1 - p) * STEPS)


def sums(codes, labels, scores, ids, trees: list[Tree], level: int, number: int, shape: Shape, width: int) -> np.ndarray:
    """Gradients and second derivatives by class, node, column and cell."""
    keep = drawn(ids, shape.seed, number, shape.rows_share) if shape.rows_share < 1 else np.ones(len(ids), bool)
    codes, (g, h) = codes[keep], whole_gradients(scores[keep], labels[keep])
    columns, nodes = codes.shape[1], 2**level
    out = np.zeros((len(trees), 2, nodes * columns * width))
    for k, tree in enumerate(trees):
        at = ((tree.node(codes, level)[:, None] * columns + np.arange(columns)) * width + codes).ravel()
        for n, x in enumerate((g, h)):
            out[k, n] = np.bincount(at, np.repeat(x[:, k], columns), nodes * columns * width)
    return out.reshape(len(trees), 2, nodes, columns, width)


def split_level(tree: Tree, level: int, total: np.ndarray, used: np.ndarray, shape: Shape) -> None:
    """Split the nodes of a level where it gains; of equal gains the first column and cell. total: sums (2, node, column,
    cell) in steps."""
    g, h = np.cumsum(total / STEPS, axis=-1)
    all_g, all_h = g[..., -1:], h[..., -1:]
    score = lambda a, b: a * a / (b + shape.l2)
    gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
    fits = (h >= shape.least_weight) & (all_h - h >= shape.least_weight) & used[:, None]
    gain = np.where(fits, np.round(gain, 9), 0.0)
    best = gain.reshape(len(gain), -1).argmax(1)
    for node, at in enumerate(best):
        column, cell = divmod(int(at), gain.shape[-1])
        if gain[node, column, cell] > 0:
            tree.column[2**level - 1 + node], tree.cell[2**level - 1 + node] = column, cell


def fill_leaves(tree: Tree, level: int, total: np.ndarray, shape: Shape) -> None:
    """Leaves from the sums of the last level of nodes, cut at their splits."""
    g, h = np.cumsum(total / STEPS, axis=-1)
    for node in range(2**level):
        at = 2**level - 1 + node
        column, cell = int(tree.column[at]), int(tree.cell[at])
        for side in (0, 1):
            left = (g[node, column, cell], h[node, column, cell]) if cell < g.shape[-1] else (g[node, column, -1], h[node, column, -1])
            a, b = left if side == 0 else (g[node, column, -1] - left[0], h[node, column, -1] - left[1])
            tree.leaf[2 * node + side] = -shape.rate * a / (b + shape.l2)


@dataclass
class Boosted:
    columns: list[str]
    classes: list[int]
    cuts: list[list[float]]
    base: list[float]
    shape: Shape
    trees: list[list[Tree]] = field(default_factory=list)

    def coded(self, rows: DataFrame) -> DataFrame:
        """Adds _codes: the cell of each column; 0 for a missing value."""
        def code(c: str, cuts: list[float]):
            x = F.col(c).cast("double")
            above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: x >= q)) if cuts else F.lit(0)
            return F.when(x.isNull() | F.isnan(x), 0).otherwise(above + 1)

        return rows.withColumn("_codes", F.array(*map(code, self.columns, self.cuts)))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with predicted (a class) and probability (by class, in the order of ``classes``)."""
        base, trees, classes = np.array(self.base), self.trees, np.array(self.classes)
        kept = [f for f in rows.schema.fields if f.name not in ("predicted", "probability")]
        schema = T.StructType([*kept, T.StructField("predicted", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = softmax(scored(_matrix(batch["_codes"]), base, trees)) if batch.num_rows else np.zeros((0, len(classes)))
                made = [pa.array(classes[p.argmax(1)], pa.int32()), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], *made], schema.names)

        return self.coded(rows).select(*[f.name for f in kept], "_codes").mapInArrow(score, schema)

    def to_json(self) -> str:
        trees = [[[x.tolist() for x in (t.column, t.cell, t.leaf)] for t in r] for r in self.trees]
        return json.dumps({"columns": self.columns, "classes": self.classes, "cuts": self.cuts, "base": self.base, "shape": asdict(self.shape), "trees": trees})

    @staticmethod
    def from_json(text: str) -> Boosted:
        x = json.loads(text)
        trees = [[Tree(np.array(c, np.int64), np.array(e, np.int64), np.array(v, float)) for c, e, v in r] for r in x["trees"]]
        return Boosted(x["columns"], x["classes"], x["cuts"], x["base"], Shape(**x["shape"]), trees)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "model string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        return Boosted.from_json(spark.read.text(path).first()[0])


def scored(codes: np.ndarray, base: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    out = np.tile(base, (len(codes), 1))
    for r in trees:
        for k, tree in enumerate(r):
            out[:, k] += tree.value(codes)
    return out


def _matrix(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def cuts_of(rows: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Distinct inner quantiles of each column."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    found = {r["column"]: r["quantiles"] for r in quantiles(long, ["column"], "x", [i / bins for i in range(1, bins)]).collect()}  # a row for each column
    return [sorted(set(found.get(c, []))) for c in columns]


def fit(rows: DataFrame, columns: Sequence[str], label: str = "label", shape: Shape = Shape()) -> Boosted:  # noqa: B008
    """Trees for the classes that occur in ``label`` (whole numbers, a few). Rows without a label teach nothing; missing
    values are a cell of their own. A ValueError without any row."""
    rows = stored(rows.where(F.col(label).isNotNull()).select(*columns, F.col(label).cast("bigint").alias("_label")), "boosting-rows")
    shares = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if not shares:
        raise ValueError("no labelled rows to fit")
    classes = sorted(shares)
    total = sum(shares.values())
    model = Boosted(list(columns), classes, cuts_of(rows, columns, shape.bins), [float(np.log(shares[c] / total)) for c in classes], shape)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("_label")) - 1
    start = F.array(*map(F.lit, model.base))
    data = stored(model.coded(rows).select(F.monotonically_increasing_id().alias("_id"), "_codes", place.alias("_class"), start.alias("_scores")), "boosting-codes")
    width, held = max((len(c) for c in model.cuts), default=0) + 2, 0  # rounds whose values are in _scores
    for number in range(shape.rounds):
        if number - held >= STORE_EVERY:
            data, held = stored(_with_scores(data, model.trees[held:]), "boosting-codes"), number
        trees = [Tree.empty(shape.depth) for _ in classes]
        rng = [np.random.default_rng([shape.seed, number, k]) for k in range(len(classes))]
        used = [r.permutation(len(columns)) < max(1, round(shape.columns_share * len(columns))) for r in rng]
        for level in range(shape.depth):
            sum_ = _pass(data, model.trees[held:], trees, level, number, shape, len(columns), width)
            for k, tree in enumerate(trees):
                split_level(tree, level, sum_[k], used[k], shape)
        for k, tree in enumerate(trees):
            fill_leaves(tree, shape.depth - 1, sum_[k], shape)
        model.trees.append(trees)
    return model


def _pass(data: DataFrame, before: list, trees: list[Tree], level: int, number: int, shape: Shape, columns: int, width: int) -> np.ndarray:
    """One level's sums: each task adds up its rows, and Spark the tasks' cells."""
    shared = data.sparkSession.sparkContext.broadcast((before, trees))
    dims = (len(trees), 2, 2**level, columns, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, trees = shared.value
        out = np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                codes = _matrix(batch["_codes"])
                scores = batch["_scores"].flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1) + 0.0
                scores = _raised(scores, codes, before)
                out += sums(codes, batch["_class"].to_numpy(), scores, batch["_id"].to_numpy(), trees, level, number, shape, width)
        cells = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(out.ravel()[cells].astype(np.int64))], ["cell", "n"])

    found = data.mapInArrow(add, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most as many as ``dims`` says
    shared.destroy()
    out = np.zeros(int(np.prod(dims)))
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out.reshape(dims)


def _raised(scores: np.ndarray, codes: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for r in trees:
        for k, tree in enumerate(r):
            scores[:, k] += tree.value(codes)
    return scores


def _with_scores(data: DataFrame, trees: list[list[Tree]]) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(trees)

    def raise_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                scores = _raised(np.stack(f["_scores"]) + 0.0, np.stack(f["_codes"]).astype(np.int64), shared.value)
                yield f.assign(_scores=list(scores))

    return data.mapInPandas(raise_, data.schema)
