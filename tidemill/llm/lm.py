"""Language-model scoring with a probabilistic suffix tree over bytes.

The text of a document is its lower-case words joined by single spaces, with one end symbol (the new line) after them;
it also stands before the first word. The tree's contexts are the last 0 to ``depth`` bytes, never beyond the start of
the document. A context is retained when it occurs ``least_count`` times or more in the training text and its
next-symbol counts diverge from those of its parent (the context without its oldest byte) by a log-likelihood gain of
``least_gain`` or more, and so are the parents of retained contexts. Contexts of fewer than NEAR bytes, which the
alphabet bounds, are all retained. Distributions are smoothed towards the parent's in proportion to the number of
distinct symbols seen. Every symbol is scored by the longest retained context before it.

The tree grows with the corpus and is never in one place. Texts are read once and dealt into blocks of some megabytes, the
distinct n-grams of a block into parts by the last NEAR bytes of their context, so that a part holds whole subtrees, and
its distinct words by their checksum. A part adds up the counts of all blocks, grows its subtrees and answers each block's
n-grams and words in their order; a block then scores its texts by these answers, the base score by the words' counts in
training. Only the levels below NEAR bytes are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, held_out, small_batches, written

END = b"\n"
LANES = 1024
#: Bytes of context that choose an n-gram's part.
NEAR = 3
#: Bytes of text in a block, and of these in a slice whose n-grams are made at once.
BLOCK = 8_000_000
SLICE = 300_000
#: What a block's texts and answers are packed with.
CODEC = pa.Codec("zstd", compression_level=5)
#: Bits of an answer's fraction that are rounded off: a log10 probability keeps 16 of 23, under 1e-5 of its size.
ROUNDED = 7


@dataclass(frozen=True)
class Settings:
    depth: int = 6
    least_count: int = 8
    #: A further share of all training positions, none by default: with it contexts must occur the more the larger the corpus.
    least_share: float = 0.0
    least_gain: float = 10.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()


def symbols(words: list[list[bytes]]) -> np.ndarray:
    """The bytes of documents in a row: end, first document, end, second document, ..., end. Byte 0 becomes 1."""
    return line_symbols([b" ".join(w) for w in words])


def line_symbols(lines: list[bytes]) -> np.ndarray:
    """The same of documents whose words are joined already."""
    return np.maximum(np.frombuffer(b"".join(END + x for x in lines) + END, np.uint8), 1)


def gram_codes(data: np.ndarray, depth: int) -> np.ndarray:
    """For every symbol but the first: the symbol in the low byte, above it its context, nearest byte lowest. Bytes
    before the start of the document are 0."""
    codes = data.astype(np.uint64)
    open_ = np.ones(len(data), bool)
    for j in range(1, depth + 1):
        back = np.zeros(len(data), np.uint64)
        back[j:] = data[:-j]
        codes |= np.where(open_, back, np.uint64(0)) << np.uint64(8 * j)
        open_ &= back != END[0]
    return codes[1:]


def mask(size: int) -> int:
    return (1 << 8 * size) - 1


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the sorted ``keys`` that are wanted, 0 for those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class Level:
    """The contexts of k bytes (sorted) with their counts, and the counts of each with a symbol (sorted codes)."""

    k: int
    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray

    def probs(self, codes: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of n-grams by their contexts of k bytes, and whether these are retained."""
        grams = codes & mask(self.k + 1)
        n, total, kinds, kept = found(self.grams, self.n, grams), *(found(self.contexts, x, grams >> 8) for x in (self.total, self.kinds, self.kept))
        if self.k == 0:  # every byte value is possible
            return (n + 0.5) / (total + 0.5 * 256), np.ones(len(codes), bool)
        return np.where(total > 0, (n + kinds * below) / np.maximum(total + kinds, 1), below), kept.astype(bool)


def grow(codes: np.ndarray, n: np.ndarray, k: int, parent: Level | None, least: float, least_gain: float) -> Level:
    """The level of k bytes from training n-grams and their counts, tested against its parents from NEAR bytes on."""
    if k:
        long = (codes >> 8 * k & 255) > 0
        codes, n = codes[long], n[long]
    grams, at = np.unique(codes & mask(k + 1), return_inverse=True)
    count = np.bincount(at, n, len(grams))
    contexts, first = np.unique(grams >> 8, return_index=True)
    kinds = np.diff(first, append=len(grams))
    total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
    kept = np.ones(len(contexts), bool)
    if k >= NEAR and len(first):
        up = grams & mask(k)
        share = parent.n[np.searchsorted(parent.grams, up)] / parent.total[np.searchsorted(parent.contexts, up >> 8)]
        gain = np.add.reduceat(count * np.log(count / np.repeat(total, kinds) / share), first)
        kept = (total >= least) & (gain >= least_gain)
    return Level(k, grams, count, contexts, total, kinds, kept)


def near_levels(codes: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    """The levels below NEAR bytes (or below ``depth``)."""
    return [grow(codes, n, k, None, 0, 0) for k in range(min(NEAR, depth))]


def near_probs(near: list[Level], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the deepest level, and by the longest context that occurs."""
    p = best = np.zeros(len(codes))
    for one in near:
        p, kept = one.probs(codes, p)
        best = np.where(kept, p, best)
    return p, best


def far_logs(codes: np.ndarray, n: np.ndarray, near: list[Level], settings: Settings, least: float) -> np.ndarray:
    """log10 probabilities of the distinct n-grams of whole subtrees, not a number where no context from the last near
    level on is retained. n is 0 for n-grams that only held-out texts have."""
    seen, levels = n > 0, [near[-1]]
    for k in range(len(near), settings.depth + 1):
        levels.append(grow(codes[seen], n[seen], k, levels[-1], least, settings.least_gain))
    for parent, child in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        parent.kept[np.searchsorted(parent.contexts, child.contexts[child.kept] & mask(parent.k))] = True
    p, out = near_probs(near, codes)[0], np.full(len(codes), np.nan)
    for one in levels[1:]:
        p, kept = one.probs(codes, p)
        out = np.where(kept, p, out)
    return np.log10(out).astype(np.float32)


def kept_bytes(depth: int) -> np.uint64:
    """The bytes of a key that hold its symbol and the ``depth`` nearest of its context."""
    return np.uint64(sum((255 << 8 * (7 - j if j <= NEAR else 6 - j) for j in range(1, depth + 1)), 255 << 24))


def keys_of(data: np.ndarray, depth: int) -> np.ndarray:
    """For every symbol but the first its n-gram, as bytes from high to low: the NEAR nearest of the context, the symbol,
    the rest of the context. Neighbours in this order mostly have one answer, which packs well."""
    padded = np.concatenate((np.zeros(7, np.uint8), data))
    back = np.ndarray(len(data) - 1, "<u8", padded, 1, (1,)).copy()  # a symbol (highest) and the seven before it
    keys = back >> 8
    keys &= 0xFFFFFF
    keys |= back >> 56 << 24
    back &= 0xFFFFFF << 32
    keys |= back
    if depth < 6:
        keys &= kept_bytes(depth)
    ends = np.flatnonzero(data == END[0])
    for k in range(1, depth):  # so many symbols after an end, no more than those are context
        keys[ends[: np.searchsorted(ends, len(data) - k)] + (k - 1)] &= kept_bytes(k)
    return keys


def codes_of(keys: np.ndarray) -> np.ndarray:
    """The same n-grams as in gram_codes."""
    turned = keys.byteswap()
    return turned >> 8 & 0xFFFFFF << 32 | turned & 0xFFFFFF << 8 | turned >> 32 & 255


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` by part, and where each part begins."""
    part = ((keys >> 32) * np.uint64(0x9E3779B97F4A7C15) >> 40) % parts
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint64), kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def places(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What finds wanted keys in the sorted ``keys``: by a table of slots, by another for those whose slot another key has,
    by search where that fails too."""

    def table(some: np.ndarray, factor: int) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
        bits = np.uint64(64 - max(8, len(some).bit_length() + 1))
        slots = np.zeros(1 << 64 - int(bits), np.int32)
        slot = lambda x: slots[x * np.uint64(factor) >> bits]
        slots[keys[some] * np.uint64(factor) >> bits] = some
        return slot, some[slot(keys[some]) != some]

    first, rest = table(np.arange(len(keys), dtype=np.int32), 0x9E3779B97F4A7C15)
    second, _ = table(rest, 0xD6E8FEB86659FD93)

    def find(wanted: np.ndarray) -> np.ndarray:
        at = first(wanted)
        other = np.flatnonzero(keys[at] != wanted)
        left = wanted[other]
        again = second(left)
        missed = np.flatnonzero(keys[again] != left)
        again[missed] = np.searchsorted(keys, left[missed])
        at[other] = again
        return at

    return find


def packed_text(text: bytes | memoryview) -> bytes:
    return CODEC.compress(text, asbytes=True)


def unpacked_text(cell: bytes, size: int) -> bytes:
    return CODEC.decompress(cell, size, asbytes=True)


def packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def packed(values: np.ndarray) -> bytes:
    """Compressed, with bytes of one weight together."""
    return CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), asbytes=True)


def unpacked(cell: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(CODEC.decompress(cell, size * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size).T).view(kind).ravel()


def rounded(logs: np.ndarray) -> np.ndarray:
    """float32 values with the last ROUNDED bits of the fraction rounded off; what is not a number stays that."""
    bits = logs.astype(np.float32).view(np.uint32)
    bits = (bits + np.uint32(1 << ROUNDED - 1)) & np.uint32(0xFFFFFFFF << ROUNDED & 0xFFFFFFFF)
    return np.where(np.isnan(logs), np.float32(np.nan), bits.view(np.float32))


def slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of documents of about SLICE bytes each (a longer document is one of its own)."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def counted(lines: list[bytes], sizes: np.ndarray, held: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of documents, in order, and how often those that aren't held out have each."""
    keys, ends = np.empty(int(sizes.sum()), np.uint64), np.concatenate(([0], np.cumsum(sizes)))
    for a, b in slices(sizes):
        some = keys[ends[a] : ends[b]]
        np.left_shift(keys_of(line_symbols(lines[a:b]), depth), 1, out=some)
        some |= np.repeat(held[a:b], sizes[a:b])
    keys.sort()
    learnt = keys.astype(np.uint8) & 1 ^ 1
    keys >>= 1
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(learnt, first, dtype=np.uint32)


def near_counts(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (codes) of the deepest level below NEAR bytes, or below ``depth``, and their counts, from all n-grams."""
    both = np.sort((codes_of(keys[n > 0]) & mask(min(NEAR, depth))) << 32 | n[n > 0])
    first = np.flatnonzero(np.diff(both >> 32, prepend=np.uint64(mask(8))))
    return both[first] >> 32, np.add.reduceat(both & mask(4), first) if len(first) else np.zeros(0, np.uint64)


def split_words(text: bytes) -> pa.DictionaryArray:
    """The words of a text in which one space follows each (and belongs to it), coded in order of appearance."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1
    offsets = np.concatenate((np.zeros(1, np.int64), ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()


def coded_words(lines: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of documents in a row, the end symbol last in each: their numbers, the distinct ones, and how many each
    document has."""
    coded = split_words(b"".join(x + b" \n " if x else b"\n " for x in lines))
    return coded.indices.to_numpy(), coded.dictionary, np.array([x.count(b" ") + 2 if x else 1 for x in lines], np.int64)


def words_by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``words`` by part, and where each part begins."""
    each = words.buffers()[2].to_pybytes().split(b" ")[:-1]
    part = np.fromiter(map(zlib.crc32, each), np.uint32, len(words)) % parts
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def block_of(rows: np.ndarray, sizes: np.ndarray, before: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Block numbers of a partition's next rows, by the bytes before each, and what to go on with."""
    part, done = int(rows[0]) >> 33, before[1] if before[0] == int(rows[0]) >> 33 else 0
    ends = done + np.cumsum(sizes + 1)
    return (part << 33) + (ends - sizes - 1) // BLOCK, (part, int(ends[-1]))


CELLS = "part bigint, block bigint, size bigint, steps binary, n binary, letters bigint, words binary, words_n binary, docs binary, code bigint, count bigint"
TOKENS = -1


def _cells(depth: int, parts: int):
    """Three kinds of rows. Of every block and part: its distinct n-grams and words, and how often its training texts have
    them. Of every block: its documents, their words joined. Of every block and n-gram below NEAR bytes: its count in
    training texts; the code TOKENS stands for these texts' number of words."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CELLS.split(", ")])

    def filled(**columns) -> pa.RecordBatch:
        made = {k: pa.array(v, schema.field(k).type) for k, v in columns.items()}
        size = len(next(iter(made.values())))
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(size, f.type) for f in schema], schema=schema)

    def cells(block: int, ids: list[pa.Array], lines: list[bytes], held: list[bool]) -> Iterator[pa.RecordBatch]:
        own = pa.table({"doc_id": pa.chunked_array(ids), "line": pa.array(lines, pa.large_binary())})
        yield filled(block=[block], docs=[packed_rows(own)])
        held = np.array(held)
        numbers, words, tokens = coded_words(lines)
        words_n = np.bincount(numbers[np.repeat(~held, tokens)], minlength=len(words)).astype(np.uint32)
        keys, n = counted(lines, np.array([len(x) + 1 for x in lines], np.int64), held, depth)
        near, near_n = near_counts(keys, n, depth)
        yield filled(code=np.append(near.view(np.int64), TOKENS), count=np.append(near_n.view(np.int64), tokens[~held].sum()))
        order, begins = by_part(keys, parts)
        keys, n = keys[order], n[order]
        order, at = words_by_part(words, parts)
        words, words_n = words.take(pa.array(order)), words_n[order]
        letters = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[at]
        text = memoryview(words.buffers()[2])
        # every part gets a cell, be it empty: its answer tells how many words the part has in all
        yield filled(
            part=np.arange(parts),
            block=np.full(parts, block),
            size=np.diff(begins),
            steps=[packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(begins, begins[1:], strict=False)],
            n=[packed(n[a:b]) for a, b in zip(begins, begins[1:], strict=False)],
            letters=np.diff(letters),
            words=[packed_text(text[a:b]) for a, b in zip(letters, letters[1:], strict=False)],
            words_n=[packed(words_n[a:b]) for a, b in zip(at, at[1:], strict=False)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, docs = None, (-1, 0), ([], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("text").to_pylist()
            blocks, before = block_of(batch.column("row").to_numpy(), np.array([len(x or "") for x in own], np.int64), before)
            firsts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).tolist()
            for low, high in zip(firsts, firsts[1:], strict=False):
                if docs[1] and blocks[low] != now:
                    yield from cells(now, *docs)
                    docs = ([], [], [])
                now = int(blocks[low])
                docs[0].append(batch.column("doc_id").slice(low, high - low))
                docs[1].extend(b" ".join(words_of(x)) for x in own[low:high])
                docs[2].extend(batch.column("held").slice(low, high - low).to_pylist())
        if docs[1]:
            yield from cells(now, *docs)

    return run


ANSWERS = "block bigint, part bigint, size bigint, logs binary, words bigint, counts binary, distinct bigint"


def _answer(near, settings: Settings, least: float):
    """The answers to each block's n-grams and words of a part, in their order, and the number of training words there."""

    def word_counts(table: pa.Table) -> tuple[list[np.ndarray], int]:
        texts = [unpacked_text(x, m) for x, m in zip(table["words"].to_pylist(), table["letters"].to_pylist(), strict=True)]
        sizes = [x.count(b" ") for x in texts]
        numbers = split_words(b"".join(texts)).indices.to_numpy()
        n = np.concatenate([unpacked(x, np.uint32, m) for x, m in zip(table["words_n"].to_pylist(), sizes, strict=True)])
        count = np.bincount(numbers, n).astype(np.int64)
        return np.split(count[numbers], np.cumsum(sizes)[:-1]), int(np.count_nonzero(count))

    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        asked = [np.cumsum(unpacked(x, np.uint64, m), dtype=np.uint64) for x, m in zip(table["steps"].to_pylist(), sizes, strict=True)]
        keys = np.unique(np.concatenate(asked))
        n, at = np.zeros(len(keys)), [np.searchsorted(keys, x) for x in asked]
        for where, x, m in zip(at, table["n"].to_pylist(), sizes, strict=True):
            n[where] += unpacked(x, np.uint32, m)
        codes = codes_of(keys)
        order = np.argsort(codes)
        logs = np.empty(len(keys), np.float32)
        logs[order] = far_logs(codes[order], n[order], near.value, settings, least)
        logs = rounded(logs)
        cells = [packed(logs[x]) for x in at]
        counts, distinct = word_counts(table)
        return pa.table({
            "block": table["block"], "part": table["part"], "size": table["size"], "logs": pa.array(cells, pa.binary()),
            "words": pa.array(map(len, counts), pa.int64()), "counts": pa.array(map(packed, counts), pa.binary()), "distinct": pa.array([distinct] * len(counts), pa.int64()),
        })

    return run


@dataclass
class Tree:
    """A small tree in one piece, to compare with, as an automaton: log10 probabilities and successors, [state * classes + class_of[byte]]; ``start`` follows an end."""

    logp: np.ndarray
    next: np.ndarray
    class_of: np.ndarray
    classes: int
    start: int
    depth: int

    def scores(self, data: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol but the first, each from the longest suffix in the tree."""
        length = max(256, -(-(len(data) - 1) // LANES))
        lanes = max(1, -(-(len(data) - 1) // length))
        warm = self.depth
        cls = np.zeros(warm + 1 + lanes * length, np.uint8)
        cls[warm + 1 - 1 : warm + len(data)] = self.class_of[data]
        view = np.lib.stride_tricks.as_strided(cls, (lanes, warm + length + 1), (length, 1))
        cells = np.ascontiguousarray(view.T)
        state, out = np.zeros(lanes, np.int32), np.empty((length, lanes), np.float32)
        for t in range(warm + 1):
            state = self.next[state * self.classes + cells[t]]
            if t < warm:
                state[0] = 0  # nothing stands before the first end symbol
        for t in range(length):
            at = state * self.classes + cells[warm + 1 + t]
            out[t] = self.logp[at]
            state = self.next[at]
        return out.T.ravel()[: len(data) - 1].astype(np.float64)

    def text_scores(self, words: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each document, its end symbol included."""
        if not words:
            return np.zeros(0)
        sizes = np.array([sum(map(len, w)) + max(len(w), 1) for w in words])
        return np.add.reduceat(self.scores(symbols(words)), np.concatenate(([0], np.cumsum(sizes)[:-1])))


def build_tree(rows: Iterable, settings: Settings) -> Tree:
    """From rows (k, ctx, sym, n, total, gain); closed under prefixes too."""
    seen: dict[tuple[int, int], dict[int, int]] = {}
    gain = {}
    for k, ctx, sym, n, _, g in rows:
        seen.setdefault((k, ctx), {})[sym] = n
        gain[k, ctx] = g
    older = lambda k, c: (k - 1, c & (1 << 8 * (k - 1)) - 1)  # noqa: E731  the parent lacks the oldest byte
    before = lambda k, c: (k - 1, c >> 8)  # noqa: E731  the prefix lacks the nearest one
    kept, todo = {(0, 0)}, [x for x in seen if x[0] and gain[x] >= settings.least_gain] + [(1, END[0])]
    while todo:  # close under suffixes and prefixes, so that the longest suffix can be followed from state to state
        x = todo.pop()
        if x not in kept:
            kept.add(x)
            todo += [older(*x), before(*x)]
    used = sorted({s for x in seen.values() for s in x} | {END[0]})
    class_of = np.full(256, len(used), np.uint8 if len(used) < 256 else np.uint16)
    class_of[used] = np.arange(len(used))
    classes, order = len(used) + 1, sorted(kept)
    number = {x: i for i, x in enumerate(order)}
    logp, follow = np.empty((len(order), classes)), np.zeros((len(order), classes), np.int32)
    prob = np.empty((len(order), classes))
    for i, x in enumerate(order):
        own = np.zeros(classes)
        for s, n in seen.get(x, {}).items():
            own[class_of[s]] = n
        if i == 0:  # every byte value is possible; the last class stands for each of those never seen
            prob[i] = (own + 0.5) / (own.sum() + 0.5 * 256)
        else:
            kinds = max(1, np.count_nonzero(own))
            prob[i] = (own + kinds * prob[number[older(*x)]]) / (own.sum() + kinds)
        for c, s in enumerate(used):
            k, ctx = min(x[0] + 1, settings.depth), (x[1] << 8 | s) & (1 << 8 * min(x[0] + 1, settings.depth)) - 1
            while (k, ctx) not in number:
                k, ctx = older(k, ctx)
            follow[i, c] = number[k, ctx]
    logp = np.log10(prob).astype(np.float32)
    return Tree(logp.ravel(), follow.ravel(), class_of, classes, number[1, END[0]], settings.depth)


SCORED = "doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(near, train: int, depth: int, parts: int):
    """A row for each document of a block."""

    def answered(answers: pa.Table, cell: str, size: str, kind: type, begins: np.ndarray) -> np.ndarray:
        """The answers of all parts in a row."""
        if answers[size].to_pylist() != np.diff(begins).tolist():
            raise ValueError("a block's texts differ from those that were counted")
        return np.concatenate([unpacked(x, kind, m) for x, m in zip(answers[cell].to_pylist(), answers[size].to_pylist(), strict=True)])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own, answers = pa.ipc.open_stream(docs["docs"][0].as_py()).read_all(), answers.sort_by("part")
        lines = own["line"].to_pylist()
        sizes, scores = np.array([len(x) + 1 for x in lines], np.int64), np.empty(len(lines))
        distinct, _ = counted(lines, sizes, np.zeros(len(lines), bool), depth)
        order, begins = by_part(distinct, parts)
        logs = np.empty(len(distinct))
        logs[order] = answered(answers, "logs", "size", np.float32, begins)
        short = np.isnan(logs)
        logs[short] = np.log10(near_probs(near.value, codes_of(distinct[short]))[1])
        where = places(distinct)
        for a, b in slices(sizes):
            wanted = keys_of(line_symbols(lines[a:b]), depth)
            scores[a:b] = np.add.reduceat(logs[where(wanted)], np.concatenate(([0], np.cumsum(sizes[a:b])[:-1])))
        numbers, words, tokens = coded_words(lines)
        order, begins = words_by_part(words, parts)
        counts = np.empty(len(words), np.int64)
        counts[order] = answered(answers, "counts", "words", np.int64, begins)
        first = np.concatenate(([0], np.cumsum(tokens)[:-1]))
        base = np.add.reduceat(np.log10(counts + 0.5)[numbers], first) - tokens * math.log10(train + 0.5 * (sum(answers["distinct"].to_pylist()) + 1))
        known = np.add.reduceat((counts > 0)[numbers], first, dtype=np.int64)
        return pa.table({"doc_id": own["doc_id"], "n_tokens": tokens, "n_known": known, "base_score": base, "score": scores})

    return run


def score_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows that are not held out (null ids train). Null and empty texts are the end token alone; repeated
    rows train and are scored each; an empty table gives an empty result; without training rows nothing is known and
    all symbols are alike. Texts are read whole, however long; other columns are not read.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", held_out(F.col("doc_id"), 5).alias("held"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    cells = written(texts.mapInArrow(_cells(settings.depth, parts), CELLS), "lm-cells")
    counts = cells.where("code is not null").groupBy("code").agg(F.sum("count").alias("n")).toPandas()  # contexts below NEAR bytes: bounded by the alphabet
    train, grams = int(counts["n"][counts["code"] == TOKENS].sum()), counts[counts["code"] != TOKENS]
    near = near_levels(grams["code"].to_numpy(np.int64).view(np.uint64), grams["n"].to_numpy(np.int64), settings.depth)
    least = max(settings.least_count, settings.least_share * float(grams["n"].sum()))
    shared = spark.sparkContext.broadcast(near)
    asked = cells.where("part is not null").select("part", "block", "size", "steps", "n", "letters", "words", "words_n")
    answers = asked.groupBy("part").applyInArrow(_answer(shared, settings, least), ANSWERS)
    blocks = cells.where("docs is not null").select("block", "docs")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared, train, settings.depth, parts), SCORED.format(kind=kind))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("bigint").alias("train_tokens"), "base_score", "score")
