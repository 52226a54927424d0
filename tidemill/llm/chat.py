"""Chat formatting by token-level assembly.

Each segment of a conversation (role, content) is encoded on its own as ordinary text; reserved ids that the tokenizer
never produces are spliced between them: turn, content, end of turn. Control strings inside a role or content are
escaped first, reversibly, so that they occur neither as ids nor as text. The loss mask over the tokens marks the
content of assistant turns; it is derived from the reserved ids by prefix sums: a token counts when more contents of
assistant turns have begun than turns have ended.

Turns are encoded each on its own, in any task; a formatted conversation is its turns' segments in order, and since a mask
opens and closes within a turn, so do theirs. Reading back streams over sorted segments, so a conversation may be of any
length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, small_batches

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
ASSISTANT = "assistant"
#: tiktoken's splitting pattern for the vocabulary below (fixed value, as published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_ranks() -> str:
    """The vocabulary where the caller names none: each machine has it at TOKENIZER_RANKS, or at the usual place."""
    return os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@functools.cache
def tokenizer(ranks_path: str):
    """The encoder and the reserved ids, which follow its last rank."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(ranks_path).read_bytes().splitlines() if line)}
    top = max(ranks.values()) + 1
    reserved = {TURN: top + 1, CONTENT: top + 2, END: top + 3}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=reserved), reserved


def escape(text: str) -> str:
    """Doubles backslashes and parts ``<|`` with one, so that no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out.append(text[at:cut] + text[cut + 1 : cut + 2])
        at = cut + 2
    return "".join(out) + text[at:]


def assemble(turns: list[tuple[str, str]], ranks_path: str) -> tuple[list[int], list[bool]]:
    """Token ids and loss mask of a conversation."""
    encoder, ids = tokenizer(ranks_path)
    tokens: list[int] = []
    for role, text in turns:
        tokens += [ids[TURN], *encoder.encode_ordinary(escape(role)), ids[CONTENT], *encoder.encode_ordinary(escape(text)), ids[END]]
    return tokens, mask_of(np.array(tokens, np.int64), ids, encoder.encode_ordinary(ASSISTANT)).tolist()


def mask_of(tokens: np.ndarray, ids: dict[str, int], assistant: list[int]) -> np.ndarray:
    """Prefix sums over the reserved ids: +1 at an assistant's CONTENT, -1 at its END; the content lies between."""
    if not len(tokens):
        return np.zeros(0, bool)
    starts, contents, ends = (np.flatnonzero(tokens == ids[x]) for x in (TURN, CONTENT, END))
    own = np.array([tokens[s + 1 : c].tolist() == assistant for s, c in zip(starts, contents, strict=True)], bool)
    step = np.zeros(len(tokens) + 1, np.int64)
    step[contents[own] + 1] += 1
    step[ends[own]] -= 1
    return np.cumsum(step[:-1]) > 0


def read_back(tokens: np.ndarray, mask: np.ndarray, ranks_path: str) -> tuple[list[tuple[str, str]], str, int]:
    """(turns, text under the loss mask, characters of the formatted text) from the tokens alone."""
    encoder, ids = tokenizer(ranks_path)
    named = {v: k for k, v in ids.items()}
    cuts = np.flatnonzero(tokens >= min(named))
    turns, loss, size, role = [], [], 0, ""
    for cut, to in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tokens)], strict=True):
        name, part, held = named[int(tokens[cut])], tokens[cut + 1 : to], mask[cut + 1 : to]
        text = encoder.decode(part.tolist())
        size += len(name) + len(text)
        if name == TURN:
            role = unescape(text)
        elif name == CONTENT:
            turns.append((role, unescape(text)))
            if held.all():
                loss.append(turns[-1][1])
            elif held.any():
                loss.append(unescape(encoder.decode(part[held].tolist())))
    return turns, "".join(loss), size


#: The order of a conversation's segments.
ORDER = ("turn", "role", "text")


def format_turns(rows: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, tokens and loss_mask, one row per turn; a conversation is its turns in the order of turn,
    role and text.

    Null roles and texts are empty; rows without a turn number come first; rows that repeat a number stand in the order of
    role and text; rows without a conv_id are one conversation; an empty table gives an empty result; texts may be of any
    length; other columns are not read.
    """
    path = ranks_path or default_ranks()
    small_batches(rows.sparkSession)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = rows.select("conv_id", "turn", empty("role"), empty("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            tokens, masks = zip(*(assemble([turn], path) for turn in turns), strict=True) if batch.num_rows else ((), ())
            made = [pa.array(tokens, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "tokens", "loss_mask"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(build, f"{own}, tokens array<int>, loss_mask array<boolean>")


def format_conversations(rows: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """conv_id, tokens and loss_mask, one row per conversation, as training examples; else as in ``format_turns``. Each
    must fit into a task; where one may not, take ``format_turns``."""
    one = F.sort_array(F.collect_list(F.struct(*ORDER, "tokens", "loss_mask"))).alias("turns")
    turns = format_turns(rows, ranks_path).groupBy("conv_id").agg(one)
    return turns.select("conv_id", F.flatten("turns.tokens").alias("tokens"), F.flatten("turns.loss_mask").alias("loss_mask"))


class Reading:
    """What the segments of one conversation have said so far."""

    def __init__(self, conv: object):
        self.conv, self.said, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.size = 0

    def add(self, tokens: np.ndarray, mask: np.ndarray, path: str) -> None:
        turns, loss, size = read_back(tokens, mask, path)
        for role, text in turns:
            self.said.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        self.loss.update(loss.encode("utf-8", "replace"))
        self.n_turns += len(turns)
        self.loss_chars += len(loss)
        self.size += size

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.size


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """What formatted conversations say when they are read back, one row for each, from whole ones or from turns.

    Turns are sorted by Spark, which spills, and read as a stream: a task holds a batch of them and the state of one
    conversation's digests, however long it is. Those of one conversation pass through one task, as a digest needs them in
    order.
    """
    path = ranks_path or default_ranks()
    small_batches(formatted.sparkSession)
    kind = next(f.dataType.simpleString() for f in formatted.schema.fields if f.name == "conv_id")
    if set(ORDER) <= set(formatted.columns):
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    names = ["conv_id", *[x.split()[0] for x in DIGESTS.split(", ")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, ids = None, [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            convs, tokens, masks = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "tokens", "loss_mask"))
            edges = tokens.offsets.to_pylist(), masks.offsets.to_pylist()
            tokens, masks = tokens.values.to_numpy(), masks.values.to_numpy(zero_copy_only=False)
            for i, conv in enumerate(convs.to_pylist()):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = Reading(conv)
                own, held = (slice(x[i], x[i + 1]) for x in edges)
                now.add(tokens[own], masks[held], path)
            if len(done) >= ARROW_ROWS:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([*done, now.row()])

    return formatted.mapInArrow(read, f"conv_id {kind}, {DIGESTS}")
