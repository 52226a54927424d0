"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into ``buckets`` embedding rows; a window of ``window``
distinct words is the mean of its words' embeddings (of ``window`` words, so that a short one says less); a linear
softmax over two classes reads it. Unseen misspellings and inflections share n-gram rows with what was seen. Labels
belong to documents: a first phase gives each window its document's label, a second one only the highest window of a
toxic document, and of the others the highest one as much as all. A document's score is the softmax of its highest
window, so one insult counts alike in a short and a very long text.
Rows that fewer than ``least_docs`` documents of the sample reach stay zero: what one document has for itself can't be
learnt by heart.

Deviation from plain averaging: an average over a whole document, or over wide windows, drowns a single word among many,
hence the narrow windows (the README has figures for wider ones).

The fit reads a bounded sample: at most ``toxic_rows`` and ``clean_rows`` labelled documents that occur, in the order of a
hash of their id, one row for each id, and of these as many as have ``sample_bytes`` of distinct words together. It runs in
one task, which is repeated if its executor is lost; the driver gets the fitted rows (4 bytes a bucket).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, free_name, held_out, small_batches

#: Everything of ASCII but letters and digits separates words.
SPLIT_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER_BYTES)


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 20
    least_docs: int = 4
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    window: int = 2
    toxic_rows: int = 1500
    clean_rows: int = 3000
    sample_bytes: int = 64 << 20
    first_steps: int = 60
    steps: int = 90
    rate: float = 0.05
    decay: float = 1e-5


def words_of(text: str | None) -> list[bytes]:
    """The distinct words in the order in which they first occur; what is said often counts once."""
    return list(dict.fromkeys((text or "").encode("utf-8", "replace").translate(SPLIT_BYTES).split()))


def grams(words: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): the embedding rows of each word's character n-grams, end marks included, and of the word itself."""
    points = np.frombuffer(b"".join(b"<%b>" % w for w in words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(points == ord("<"))
    lengths = np.diff(np.append(starts, len(points)))
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(words)), lengths)
    rows, owners, code = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, shape.longest + 1):
        code[: len(points) - n + 1] += points[n - 1 :] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
        if n >= shape.shortest:
            at = np.flatnonzero(left >= n)
            mixed = (code[at] ^ (code[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            rows.append((mixed >> np.uint64(32)) % np.uint64(shape.buckets))
            owners.append(owner[at])
    rows.append(np.fromiter((zlib.crc32(w) % shape.buckets for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


class Bag:
    """Words of a corpus as ids, and their grams in one flat array."""

    def __init__(self, texts: list[str | None], shape: Shape):
        ids: dict[bytes, int] = {}
        tokens, windows = [], []
        for text in texts:
            own = [ids.setdefault(w, len(ids)) for w in words_of(text)]
            tokens.append(own)
            windows.append(max(1, -(-len(own) // shape.window)))
        lengths = np.array([len(x) for x in tokens])
        self.token = np.fromiter((y for x in tokens for y in x), np.int32, lengths.sum())
        self.window_of = np.concatenate([np.arange(n) // shape.window + s for n, s in zip(lengths, np.cumsum([0, *windows[:-1]]), strict=True)]).astype(np.int32)
        self.n_windows = int(sum(windows))
        self.doc_of = np.repeat(np.arange(len(texts)), windows)
        self.first = np.cumsum([0, *windows[:-1]])
        vocabulary, parts = list(ids), []
        for at in range(0, len(vocabulary), 20_000):  # in small numbers, piece by piece: this runs on the driver
            row, word = grams(vocabulary[at : at + 20_000], shape)
            parts.append((row.astype(np.int32), (word + at).astype(np.int32)))
        row, word = (np.concatenate(x) if parts else np.zeros(0, np.int32) for x in (list(zip(*parts, strict=True)) or ((), ())))
        pairs = np.unique(self.doc_of[self.window_of].astype(np.int64) * len(ids) + self.token) if len(ids) else np.zeros(0, np.int64)
        docs = np.bincount(row, np.bincount(pairs % max(len(ids), 1), minlength=len(ids))[word], shape.buckets)  # documents by word
        self.rows = np.flatnonzero(docs >= shape.least_docs)
        place = np.full(shape.buckets, -1, np.int32)
        place[self.rows] = np.arange(len(self.rows), dtype=np.int32)
        self.n_grams = np.bincount(word, minlength=len(ids))
        row = place[row]
        self.gram, self.word_of = row[row >= 0], word[row >= 0]


@dataclass
class Fitted:
    """Fitted embeddings E, class weights W (two columns) and bias b."""

    E: np.ndarray
    W: np.ndarray
    b: np.ndarray

    def rows(self) -> np.ndarray:
        """Each embedding row's share of the logit of class 1 against class 0."""
        return (self.E @ (self.W[:, 1] - self.W[:, 0])).astype(np.float32)

    @property
    def bias(self) -> float:
        return float(self.b[1] - self.b[0])


@dataclass
class Model:
    """What a score needs of the fit: each embedding row's share of the logit, and the bias."""

    shape: Shape
    rows: np.ndarray
    bias: float


def fit(texts: list[str | None], labels: np.ndarray, shape: Shape | None = None, seed: int = 7) -> Fitted:
    """Joint full-batch training (Adam) of embeddings and softmax. Without both labels the model scores the prior."""
    shape = shape or Shape()
    rng = np.random.default_rng(seed)
    W = rng.normal(0, 0.1, (shape.dim, 2))
    b = np.zeros(2)
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        rate = np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99)
        return Fitted(np.zeros((shape.buckets, shape.dim), np.float32), W, np.array([0.0, np.log(rate / (1 - rate))]))
    bag, state = Bag(texts, shape), {}
    E = rng.normal(0, 0.1, (len(bag.rows), shape.dim)).astype(np.float32)
    truth = labels[bag.doc_of]
    per_doc = 1 / np.bincount(bag.doc_of)[bag.doc_of]

    def adam(name: str, x: np.ndarray, g: np.ndarray, t: int) -> None:
        m, v = state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= shape.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for t in range(1, shape.first_steps + shape.steps + 1):
        lean = E @ (W[:, 1] - W[:, 0])
        word = np.bincount(bag.word_of, lean[bag.gram], len(bag.n_grams)) / np.maximum(bag.n_grams, 1)
        logit = np.bincount(bag.window_of, word[bag.token], bag.n_windows) / shape.window + b[1] - b[0]
        weight = np.ones(bag.n_windows)
        if t > shape.first_steps:  # of a toxic document only its highest window is toxic
            top = np.maximum.reduceat(logit, bag.first)
            highest = logit >= top[bag.doc_of]
            weight = np.where(truth > 0, highest, highest + per_doc)
        for y, share in ((0.0, 0.4), (1.0, 0.6)):  # a toxic document missed costs more than a clean one lost
            weight[truth == y] *= share / max(weight[truth == y].sum(), 1e-9)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - truth) * weight
        by_word = np.bincount(bag.token, (error / shape.window)[bag.window_of], len(bag.n_grams)) / np.maximum(bag.n_grams, 1)
        by_row = np.bincount(bag.gram, by_word[bag.word_of], len(bag.rows))
        slope = E.T @ by_row
        adam("E", E, np.outer(by_row, W[:, 1] - W[:, 0]).astype(np.float32) + shape.decay * E, t)
        adam("W", W, np.column_stack((-slope, slope)) + shape.decay * W, t)
        adam("b", b, np.array([-error.sum(), error.sum()]), t)
    whole = np.zeros((shape.buckets, shape.dim), np.float32)
    whole[bag.rows] = E
    return Fitted(whole, W, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, shape: Shape) -> DataFrame:
    """words (the distinct ones) and toxic of a bounded number of documents (see above); held-out rows and rows without a
    label stay out. Of rows that repeat an id the smallest text is read."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"), 3)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marks.where(f"toxic = {y}").orderBy(*order).limit(n) for y, n in ((1, shape.toxic_rows), (0, shape.clean_rows))]
    chosen = chosen[0].unionByName(chosen[1])

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"], "words": [b" ".join(words_of(x)) for x in f["text"]]})

    # a bounded number of ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.mapInPandas(distinct, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, words binary")
    so_far = F.sum(F.length("words")).over(Window.orderBy(*order))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= shape.sample_bytes).select("doc_id", "words", "toxic")


def fit_sample(sample: DataFrame, shape: Shape) -> Model:
    """The model of a bounded sample, fitted in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        f = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "words": [], "toxic": []})
        f = f.sort_values(["doc_id", "words"], kind="stable")
        made = fit([bytes(x).decode("utf-8", "replace") for x in f["words"]], f["toxic"].to_numpy(), shape)
        yield pd.DataFrame({"rows": [made.rows().tobytes()], "bias": [made.bias]})

    row = sample.coalesce(1).mapInPandas(run, "rows binary, bias double").first()
    if not row:  # not even an empty partition
        return Model(shape, (none := fit([], np.zeros(0), shape)).rows(), none.bias)
    return Model(shape, np.frombuffer(row["rows"], np.float32), row["bias"])


_CACHE: dict[object, dict[bytes, float]] = {}


def word_scores(model: object, most: int = 400_000) -> dict[bytes, float]:
    """This process's cache of word scores for ``model``, emptied beyond ``most`` words to bound its memory."""
    if model not in _CACHE or len(_CACHE[model]) > most:
        _CACHE.clear()
        _CACHE[model] = {}
    return _CACHE[model]


def learn(words: set[bytes], rows: np.ndarray, cache: dict[bytes, float], shape: Shape) -> None:
    """Add the scores of the words that the cache lacks: the mean of their embedding rows' shares."""
    new = list(words.difference(cache))
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        gram, word = grams(part, shape)
        cache.update(zip(part, (np.bincount(word, rows[gram], len(part)) / np.bincount(word, minlength=len(part))).tolist(), strict=True))


def text_scores(texts: Sequence[str | None], rows: np.ndarray, bias: float, cache: dict[bytes, float], shape: Shape) -> list[float]:
    words = [words_of(x) for x in texts]
    learn(set().union(*words), rows, cache, shape)
    out = []
    for text in words:
        top = 0.0
        if text:
            own = np.fromiter(map(cache.__getitem__, text), np.float64, len(text))
            starts = np.arange(0, len(text), shape.window)
            top = np.add.reduceat(own, starts).max() / shape.window
        out.append(float(1 / (1 + np.exp(-np.clip(top + bias, -40, 40)))))
    return out


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``out`` (0 to 1); null and empty texts get the score of the bias alone. An input
    column of that name is left out."""
    spark = docs.sparkSession
    small_batches(spark)
    shared: Broadcast = spark.sparkContext.broadcast((model.rows, model.bias, model.shape))  # 4 bytes a bucket
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, bias, shape = shared.value
        for frame in frames:
            texts, found = frame["text"].tolist(), []
            for at in range(0, len(texts), 64):
                found += text_scores(texts[at : at + 64], rows, bias, word_scores(name), shape)
            frame[out] = found
            yield frame

    own = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", `{out}` double"
    return docs.select(*[f"`{f.name}`" for f in own]).mapInPandas(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, shape: Shape | None = None, out: str = "toxicity") -> DataFrame:
    """Fit on the labelled rows that are not held out, score every row of ``docs``, each by its whole text.

    An empty document table gives an empty result; without labels of both kinds every row gets the prior. Repeated ids
    are scored row by row; for an id labelled twice the higher label counts.
    """
    shape = shape or Shape()
    return score(docs, fit_sample(labelled_sample(docs, labels, shape), shape), out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, shape: Shape | None = None) -> DataFrame:
    """The documents that score below ``threshold``, with the columns of ``docs`` and their own values; null and empty
    texts, ties, repeats and empty tables are as in ``score_documents``."""
    name = free_name(docs, "_toxicity")
    return score_documents(docs, labels, shape, name).where(F.col(name) < threshold).select(*[f"`{c}`" for c in docs.columns])
