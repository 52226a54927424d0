"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair of ids does.

First pass: each text is encoded by both tokenizers; the ids are stored, and so are the distinct pairs of ids whose
occurrences end at one byte. Over the distinct pairs of all tasks a minimal perfect hash is built: pairs are dealt to
shards by a hash, and each shard places its keys by levels of bits (a key stands where no other falls; those that collide
go to the next level), so a pair's number is the rank of its bit. Then tasks count pairs in dense vectors indexed by that
number, which are summed as a tree. The keys are kept in the order of their numbers, so that a lookup is verified.
Last pass: stored ids are aligned again and each link's count is looked up.

Pairs are looked up from broadcast shards. A vocabulary product bounds them, though not usefully; so shards are handed out
in groups of at most ``GROUP_PAIRS`` pairs, one pass over the stored ids for each group, and results of passes are added.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Pairs of a shard on average, and of all shards that are broadcast together (bounds the broadcast: about 13 bytes a pair).
SHARD_PAIRS, GROUP_PAIRS = 1 << 16, 1 << 21
#: Bits a key at each level, and levels; what is left after them (all but never anything) is looked up by search.
SPREAD, LEVELS = 2, 24
#: Vectors that are summed in one step of the tree.
FAN_IN = 16
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 20
#: The splitting pattern of the byte-level vocabulary (fixed value, as published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizers() -> tuple[str, str]:
    """Where the caller names none: the folder TOKENIZERS, or the usual place, on each machine."""
    folder = os.environ.get("TOKENIZERS", "/opt/tokenizers")
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"


# ---- tokenizers: texts to ids, ids to bytes ----


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints as its own character and the others as those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Byte-level BPE from a ``tokenizer.json``; special tokens' strings inside texts are plain text.

    Merging by the order of ids gives what the file's merges give if each makes the next id, which is checked.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        of, special = byte_alphabet(), {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        decoded = {i: bytes(of[c] for c in t) for t, i in said["model"]["vocab"].items() if t not in special}
        ranks = {b: i for i, b in decoded.items()}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in said["model"]["merges"]]
        if [said["model"]["vocab"][m] for m in made] != list(range(256, 256 + len(made))) or len(ranks) != len(decoded):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.encoder = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [decoded.get(i, b"") for i in range(max(decoded) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoder.encode_ordinary(" " + t), np.uint16) for t in texts]


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace("▁", " ").encode()
            for i in range(m.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint16) for x in self.model.encode(texts, num_threads=1)]


class Table:
    """Bytes of ids: their lengths, and the joined bytes of a run of ids."""

    def __init__(self, entries: list[bytes]):
        if len(entries) > 1 << 16:
            raise ValueError("ids must fit into two bytes")
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.entries = pa.array(entries, pa.large_binary())

    def joined(self, ids: np.ndarray) -> memoryview:
        return data_of(self.entries.take(pa.array(ids)))


def data_of(values: pa.Array) -> memoryview:
    """The bytes of a (large) string or binary array, one after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2] or b"").cast("B")[int(offsets[0]) : int(offsets[-1])] if len(values) else memoryview(b"")


@functools.cache
def tools(a_path: str, b_path: str) -> tuple:
    a, b = ByteLevel(a_path), Pieces(b_path)
    return a, b, Table(a.bytes), Table(b.bytes)


@functools.cache
def tables(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    _, _, a, b = tools(a_path, b_path)
    return a.lengths, b.lengths


# ---- alignment of many texts at once ----


@dataclass
class Ends:
    """Tokens of several texts, one after the other.

    a, b: which tokens end a group, by place; a_text, b_text: offsets of the texts among the tokens.
    """

    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray

    def links(self) -> np.ndarray:
        """Number of links of each text: one for each group, as all entries have bytes."""
        return np.diff(np.searchsorted(self.a, self.a_text, "left"))


def align(a_ids: np.ndarray, a_text: np.ndarray, b_ids: np.ndarray, b_text: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> Ends:
    """Where tokens of both kinds end together. Both kinds of a text must have the same bytes, so that ends of all texts
    lie on one line."""
    a_end, b_end = np.cumsum(lengths[0][a_ids]), np.cumsum(lengths[1][b_ids])
    size = int(a_end[-1]) if len(a_end) else 0
    at_b = np.zeros(size + 1, bool)
    at_b[b_end] = True
    a = np.flatnonzero(at_b[a_end]) if len(a_end) else np.empty(0, np.int64)
    at_b[:] = False
    at_b[a_end[a]] = True
    b = np.flatnonzero(at_b[b_end]) if len(b_end) else np.empty(0, np.int64)
    return Ends(a, b, a_text, b_text)


def keys_of(a_ids: np.ndarray, b_ids: np.ndarray, ends: Ends) -> np.ndarray:
    """The pairs of ids of all links, as one number each."""
    return a_ids[ends.a].astype(np.uint32) << 16 | b_ids[ends.b].astype(np.uint32)


@functools.cache
def _decimals() -> pa.Array:
    """``id,`` then ``id|`` then ``id;`` for all ids."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(1 << 16)], pa.large_string())


def group_digests(a_ids: np.ndarray, b_ids: np.ndarray, ends: Ends) -> list[str]:
    """Of each text the hex digest of ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    a_mark, b_mark = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_mark[ends.a], b_mark[ends.b] = 1, 2
    # a token of A comes after the tokens of B of the groups before its own, one of B after those of A of its group too
    a_group, b_group = np.cumsum(a_mark > 0) - (a_mark > 0), np.cumsum(b_mark > 0) - (b_mark > 0)
    b_until, a_until = np.concatenate([[0], ends.b + 1]), ends.a + 1
    line = np.empty(len(a_ids) + len(b_ids), np.int64)
    line[np.arange(len(a_ids)) + b_until[a_group]] = a_ids + (a_mark << 16)
    line[np.arange(len(b_ids)) + a_until[b_group]] = b_ids + (b_mark << 16)
    out, cuts = [], ends.a_text + ends.b_text
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(hashlib.sha256(data_of(_decimals().take(pa.array(line[begin:end])))[:-1]).hexdigest() if end > begin else "")
    return out


def encoded(texts: list[str], paths: tuple[str, str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both tokenizers; none for a text that is empty or whose joined bytes differ from a space and the text."""
    one, two, one_table, two_table = tools(*paths)
    a, b = one.encode(texts), two.encode(texts)
    none = np.empty(0, np.uint16)
    for i, text in enumerate(texts):
        whole = (" " + text).encode()
        if not text or one_table.joined(a[i]) != whole or two_table.joined(b[i]) != whole:
            a[i] = b[i] = none
    return a, b


def offsets(parts: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


# ---- a minimal perfect hash of distinct pairs ----


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (multiply and shift)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(shards)).astype(np.int64)


def build_shard(keys: np.ndarray) -> tuple[bytes, list[int], np.ndarray]:
    """Bits of all levels, bits a level, and the keys by number; ``keys`` are distinct."""
    left, levels, words, ordered = keys, [], [], []
    while len(left) and len(levels) < LEVELS:
        size = -(-SPREAD * len(left) // 64) * 64
        place = (mixed(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little"))
        here = alone[place]
        ordered.append(left[here][np.argsort(place[here])])
        levels.append(size)
        left = left[~here]
    ordered.append(np.sort(left))  # beyond the last level, by search
    return b"".join(w.tobytes() for w in words), levels, np.concatenate(ordered).astype(np.uint32)


class PerfectHash:
    """Several shards, one after the other: numbers of keys, verified."""

    def __init__(self, numbers: list[int], shards: int, bits: list[bytes], levels: list[list[int]], keys: list[np.ndarray]):
        """numbers: which of all ``shards`` are held."""
        self.shards, self.held = shards, np.full(shards, -1)
        self.held[numbers] = np.arange(len(numbers))
        self.words = np.frombuffer(b"".join(bits), np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.size = np.zeros((LEVELS, len(numbers)), np.uint64)
        self.base = np.zeros((LEVELS, len(numbers)), np.int64)
        at = 0
        # Numbers follow bits; keys beyond the last level have none, and come after their shard's.
        self.shift, self.rest, extra, begin = np.zeros(len(numbers), np.int64), {}, 0, 0
        for s, sizes in enumerate(levels):
            for n, size in enumerate(sizes):
                self.size[n, s], self.base[n, s] = size, at
                at += size
            self.shift[s] = extra
            placed = int(ones[: at // 64].sum()) + extra - begin
            for i in range(placed, len(keys[s])):
                self.rest[int(keys[s][i])] = begin + i
            extra += len(keys[s]) - placed
            begin += len(keys[s])
        self.keys = np.concatenate([*keys, np.empty(0, np.uint32)])

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 where its shard isn't held. Fails for a key that was never given."""
        out = np.full(len(keys), -1)
        shard = self.held[shard_of(keys, self.shards)] if self.shards > 1 else np.zeros(len(keys), np.int64)
        todo = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            if not len(todo):
                break
            size = self.size[level, shard[todo]]
            todo, size = (todo, size) if size.all() else (todo[size > 0], size[size > 0])
            k, s = keys[todo], shard[todo]
            bit = self.base[level, s] + (mixed(k, level + 1) % size).astype(np.int64)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            number = self.rank[bit >> 6] + before + self.shift[s]
            hit[hit] = self.keys[number[hit]] == k[hit]  # a key may fall on another's place
            out[todo[hit]] = number[hit]
            todo = todo[~hit]
        for i in np.flatnonzero((out < 0) & (shard >= 0)) if self.rest else ():
            out[i] = self.rest.get(int(keys[i]), -1)
        if ((out < 0) & (shard >= 0)).any():
            raise KeyError("a pair is unknown to the hash")
        return out


# ---- over Spark ----

STORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a binary, b binary, pairs binary"


def encode_documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row for each document with its ids (two bytes each); rows with ``pairs`` (four bytes each) alone have the distinct
    pairs of a task's documents."""
    small_batches(docs.sparkSession)

    names = [c.split()[0] for c in STORED.split(", ")]

    def pairs_row(pairs: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([pairs.tobytes()], pa.binary())], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lengths = [], tables(*paths)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = encoded([t or "" for t in batch["text"].to_pylist()], paths)
            a_text, b_text = offsets(a), offsets(b)
            a_ids, b_ids = np.concatenate(a), np.concatenate(b)
            ends = align(a_ids, a_text, b_ids, b_text, lengths)
            held.append(np.unique(keys_of(a_ids, b_ids, ends)))
            if sum(map(len, held)) > HELD_PAIRS:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield pairs_row(held.pop())
            figures = [pa.array(x) for x in (np.diff(a_text), np.diff(b_text), ends.links(), group_digests(a_ids, b_ids, ends))]
            ids = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (a, b)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *figures, *ids, pa.nulls(batch.num_rows, pa.binary())], names)
        if held:
            yield pairs_row(np.unique(np.concatenate(held)))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, STORED)


def distinct_pairs(stored: DataFrame) -> DataFrame:
    """``key`` of each distinct pair."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["pairs"]:
                keys = np.frombuffer(x.as_buffer(), np.uint32)
                for begin in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[begin : begin + (1 << 16)].astype(np.int64))], ["key"])

    return stored.where("pairs is not null").select("pairs").mapInArrow(unpack, "key bigint").distinct()


def build_hash(pairs: DataFrame, shards: int) -> DataFrame:
    """``shard, bits, levels, keys`` of each shard that has pairs."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy().astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards)), batch["key"]], ["shard", "key"])

    def build(table: pa.Table) -> pa.Table:
        bits, levels, keys = build_shard(table["key"].to_numpy().astype(np.uint32))
        return pa.table({"shard": table["shard"][:1], "bits": [bits], "levels": pa.array([levels], pa.list_(pa.int64())), "keys": [keys.tobytes()]})

    dealt = pairs.mapInArrow(deal, "shard bigint, key bigint")
    return dealt.groupBy("shard").applyInArrow(build, "shard bigint, bits binary, levels array<bigint>, keys binary")


def _held(rows: list, shards: int) -> PerfectHash:
    return PerfectHash([r.shard for r in rows], shards, [bytes(r.bits) for r in rows], [r.levels for r in rows], [np.frombuffer(r["keys"], np.uint32) for r in rows])


def _stored_batches(batches: Iterator[pa.RecordBatch], lengths: tuple) -> Iterator[tuple[pa.RecordBatch, Ends, np.ndarray]]:
    """Each batch of stored ids with its alignment and the pairs of its links."""
    for batch in batches:
        parts = [[np.frombuffer(x.as_buffer(), np.uint16) for x in batch[c]] for c in ("a", "b")]
        ids = [np.concatenate(p) if p else np.empty(0, np.uint16) for p in parts]
        ends = align(ids[0], offsets(parts[0]), ids[1], offsets(parts[1]), lengths)
        yield batch, ends, keys_of(*ids, ends)


def count_pairs(stored: DataFrame, rows: list, shards: int, paths: tuple[str, str]) -> DataFrame:
    """``shard, counts`` (eight bytes a pair, in the order of the shard's keys) for the shards in ``rows``.

    Each task counts into one dense vector; the vectors of a shard are summed FAN_IN at a time.
    """
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast(_held(rows, shards))
    numbers, cuts = [r.shard for r in rows], np.cumsum([len(r["keys"]) // 4 for r in rows])[:-1].astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = shared.value, np.zeros(len(shared.value), np.int64)
        for _, _, keys in _stored_batches(batches, tables(*paths)):
            at = index.numbers(keys)
            total += np.bincount(at[at >= 0], minlength=len(total))
        for number, part in zip(numbers, np.split(total, cuts) if numbers else [], strict=True):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.tobytes()], pa.binary())], ["shard", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = number = None
        for batch in parts:
            for n, x in zip(batch["shard"].to_pylist(), batch["counts"], strict=True):
                more = np.frombuffer(x.as_buffer(), np.int64)
                total, number = more if total is None else total + more, n
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([total.tobytes()], pa.binary())], ["shard", "counts"])

    vectors = stored.select("a", "b").mapInArrow(count, "shard bigint, counts binary")
    branch = F.floor(F.spark_partition_id() / FAN_IN)
    steps, many = 1, max(2, stored.rdd.getNumPartitions())
    while FAN_IN**steps < many:
        steps += 1
    for step in range(steps):
        at = branch if step == 0 else F.floor(F.col("branch") / FAN_IN)
        dealt = vectors.withColumn("branch", at.cast("bigint"))
        keep = dealt.groupBy("shard", "branch")
        vectors = keep.applyInArrow(_with_branch(add), "shard bigint, branch bigint, counts binary")
    return vectors.select("shard", "counts")


def _with_branch(add):
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in add(parts):
            yield pa.RecordBatch.from_arrays([out["shard"], pa.array([key[1].as_py()], pa.int64()), out["counts"]], ["shard", "branch", "counts"])

    return run


def highest(hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """``b, best``: the highest count of each id of B."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch["keys"], batch["counts"], strict=True):
                b, n = np.frombuffer(keys.as_buffer(), np.uint32) & 0xFFFF, np.frombuffer(n.as_buffer(), np.int64)
                best = np.zeros(1 << 16, np.int64)
                np.maximum.at(best, b, n)
                held = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(best[held])], ["b", "best"])

    joined = hashes.select("shard", "keys").join(counts, "shard")
    return joined.select("keys", "counts").mapInArrow(each, "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best"))


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def look_up(stored: DataFrame, rows: list, counted: dict, best: np.ndarray, shards: int, paths: tuple[str, str]) -> DataFrame:
    """Rows of ``stored`` with ``n_best, count_sum`` over the links whose pairs lie in the shards of ``rows``."""
    vectors = [np.frombuffer(counted[r.shard], np.int64) for r in rows] or [np.zeros(1, np.int64)]
    shared = stored.sparkSession.sparkContext.broadcast((_held(rows, shards), np.concatenate(vectors), best))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, best = shared.value
        for batch, ends, keys in _stored_batches(batches, tables(*paths)):
            at = index.numbers(keys)
            n = np.where(at >= 0, counts[at], 0)
            top = (at >= 0) & (n == best[keys & 0xFFFF])
            cuts = np.concatenate([[0], np.cumsum(ends.links())])
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])) for x in (top.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ["_row", *FIGURES]], *sums], ["_row", *FIGURES, "n_best", "count_sum"])

    schema = "_row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return stored.select("_row", *FIGURES, "a", "b").mapInArrow(ask, schema)


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each row of ``docs``.

    Null and empty texts, and those whose tokens don't give a space and the text back in either vocabulary, have zeros and
    an empty ``groups_sha256``. Rows that repeat or have no id are rows of their own, and their links count as others do.
    Texts are encoded whole. An empty table gives none. Other columns than doc_id and text are not looked at.
    """
    paths = paths or default_tokenizers()
    stored = written(encode_documents(docs, paths).withColumn("_row", F.monotonically_increasing_id()), "token-ids")
    whole = stored.where("pairs is null").withColumn("n_links", F.col("n_groups"))  # every entry has bytes, so a group has one link
    pairs = written(distinct_pairs(stored), "pairs")
    shards = max(1, -(-pairs.count() // SHARD_PAIRS))
    hashes = written(build_hash(pairs, shards), "hash")
    each = max(1, GROUP_PAIRS // SHARD_PAIRS)
    groups = [hashes.where((F.col("shard") >= n) & (F.col("shard") < n + each)).orderBy("shard") for n in range(0, shards, each)]
    counts = None
    for group in groups:
        now = written(count_pairs(whole, group.collect(), shards, paths), "counts")
        counts = now if counts is None else counts.unionByName(now)
    best = np.zeros(1 << 16, np.int64)
    for r in highest(hashes, counts).collect():  # a row for each id of B
        best[r.b] = r.best
    found = None
    for group in groups:
        rows = group.collect()
        counted = {r.shard: r["counts"] for r in counts.where(F.col("shard").isin([r.shard for r in rows])).collect()}
        now = look_up(whole, rows, counted, best, shards, paths)
        found = now if found is None else found.unionByName(now)
    if len(groups) > 1:
        found = found.groupBy("_row", *FIGURES).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*FIGURES, "n_best", "count_sum")

