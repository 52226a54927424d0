"""Secret scan with one combined deterministic automaton over bytes.

The rules' regular expressions are compiled together: positions (Glushkov) sets by subset construction, minimised by
partition refinement, laid out as one transition array. A batch of texts is scanned in one pass for all rules at once:
the bytes are cut into equal stretches that advance side by side in numpy; a stretch that was started in a wrong state
is run again from the right one until it meets what is known, so the result is that of a sequential scan.

The scan reports where some match of a rule is complete, or has begun for the rules in BEGINS. The extent of each match
follows from two more automata of the rule: the reversed one, run back from that place to the leftmost start, and the rule
itself, run on to the longest end; the next match of the rule begins no earlier than that end. This gives leftmost, longest,
non-overlapping matches for rules in which an earlier start never completes later than a later one, as holds for those
below.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

#: The kinds in their order, with the expression that is scanned for. Matches of ``assign`` are dropped
#: when the value has fewer than 8 characters (after matching, as a short value still takes its text); the lengths of
#: the others are part of the expression, which is the same as dropping short ones since their runs are maximal.
BASE_RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
#: The further rules take a secret's whole extent. A private key reaches to its END line, or is its BEGIN line where none
#: follows; its text holds no two dashes in a row. Lengths are least ones, with open ends.
MORE_RULES = {
    "slack": r"xox[abprs]-[0-9]{8,}(-[A-Za-z0-9]+)*",
    "private_key": r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
    r"(([\x00-\x2C\x2E-\xFE]|-[\x00-\x2C\x2E-\xFE])*-----END (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----)?",
    "mail_key": r"SG\.[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]+)?",
    "github": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+",
    "stripe": r"[rs]k_live_[A-Za-z0-9]{16,}",
    "gitlab": r"glpat-[A-Za-z0-9_-]{16,}",
    "google": r"AIza[A-Za-z0-9_-]{35,}",
    "npm": r"npm_[A-Za-z0-9]{30,}",
    "pypi": r"pypi-[A-Za-z0-9_-]{50,}",
    "twilio": r"SK[0-9a-f]{32}",
    "sk_key": r"sk-[A-Za-z0-9_-]{32,}",
    "url_login": r"[a-z]+://[A-Za-z0-9._%~-]+:[A-Za-z0-9._%~!$&*+=-]+@",
}
#: What the combined automaton looks for in place of a whole further rule, so that it stays small: how a match begins.
#: The rule's own automaton decides from there on.
BEGINS = {
    MORE_RULES["slack"]: r"xox[abprs]-",
    MORE_RULES["private_key"]: r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    MORE_RULES["mail_key"]: r"SG\.",
    MORE_RULES["github"]: r"gh[pousr]_",
    MORE_RULES["jwt"]: r"eyJ",
    MORE_RULES["stripe"]: r"[rs]k_live_",
    MORE_RULES["gitlab"]: r"glpat-",
    MORE_RULES["google"]: r"AIza",
    MORE_RULES["npm"]: r"npm_",
    MORE_RULES["pypi"]: r"pypi-",
    MORE_RULES["twilio"]: r"SK[0-9a-f]",
    MORE_RULES["sk_key"]: r"sk-",
    MORE_RULES["url_login"]: r"[a-z]+://",
}
VALUE_LENGTH = 8
#: Kinds that stand alone, bytes that may not come before them, and those of which a key has some.
ALONE = frozenset(MORE_RULES) - {"private_key", "url_login"}
MIXED_BYTES = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD_BYTES = MIXED_BYTES | frozenset(b"abcdefghijklmnopqrstuvwxyz_-")
#: A byte that UTF-8 never holds; it stands between texts and takes every state back to the start.
END = 255
LANES = 1024


class Positions:
    """Glushkov construction: each consuming place of an expression is a position with a set of bytes."""

    def __init__(self):
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def place(self, accepted: frozenset[int]) -> tuple[bool, set[int], set[int]]:
        self.sets.append(accepted)
        self.follow.append(set())
        return False, {len(self.sets) - 1}, {len(self.sets) - 1}

    def then(self, a, b):
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def build(self, parsed, flags: int, backward: bool):
        """(may be empty, first positions, last positions) of a parsed expression."""
        out = (True, set(), set())
        for op, arg in list(parsed)[:: -1 if backward else 1]:
            name, part = str(op), None
            if name in ("LITERAL", "IN"):
                part = self.place(_byte_set(name, arg, flags))
            elif name == "SUBPATTERN":
                part = self.build(arg[3], flags | arg[1], backward)
            elif name == "BRANCH":
                parts = [self.build(x, flags, backward) for x in arg[1]]
                part = any(x[0] for x in parts), set().union(*(x[1] for x in parts)), set().union(*(x[2] for x in parts))
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                part = (True, set(), set())
                for _ in range(low if high == re._constants.MAXREPEAT else high):
                    one = self.build(inner, flags, backward)
                    part = self.then(part, one if _ < low else (True, *one[1:]))
                if high == re._constants.MAXREPEAT:
                    again = self.build(inner, flags, backward)
                    for p in again[2]:
                        self.follow[p] |= again[1]
                    part = self.then(part, (True, *again[1:]))
            else:
                raise ValueError(f"not supported in a rule: {name}")
            out = self.then(out, part)
        return out


def _byte_set(name: str, arg, flags: int) -> frozenset[int]:
    found: set[int] = set()
    for op, x in [("LITERAL", arg)] if name == "LITERAL" else [(str(o), y) for o, y in arg]:
        if op == "LITERAL":
            found.add(x)
        elif op == "RANGE":
            found |= set(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    if flags & re.IGNORECASE:
        found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + class_of[byte]]; states from ``first_accept`` accept the rules in accepts[state]. State 0 starts."""

    next: np.ndarray
    class_of: np.ndarray
    classes: int
    first_accept: int
    accepts: tuple[int, ...]
    dead: int


def compile_rules(rules: list[str], search: bool, backward: bool = False) -> Automaton:
    """Subset construction and minimisation. ``search``: a match may begin at every byte."""
    pos, heads, tails = Positions(), [], {}
    for n, rule in enumerate(rules):
        _, first, last = pos.build(re._parser.parse(rule), 0, backward)
        heads += first
        for p in last:
            tails[p] = tails.get(p, 0) | 1 << n
    sets = [frozenset(heads)]
    ids, rows, bits = {sets[0]: 0}, [], [0]
    kinds = sorted({tuple(b in s for s in pos.sets) for b in range(256)})
    class_of = np.array([kinds.index(tuple(b in s for s in pos.sets)) for b in range(256)], np.uint8)
    class_of[END] = len(kinds)
    classes = len(kinds) + 1
    ids_by_kind = [[p for p in range(len(pos.sets)) if k[p]] for k in kinds]
    allowed = [set(x) for x in ids_by_kind]
    start = frozenset(heads)
    for now in sets:  # grows while it is read: a set holds the positions that may be consumed next
        row = []
        for c in range(classes - 1):
            took = now & allowed[c]
            then = frozenset().union(*(pos.follow[p] for p in took)) | (start if search else frozenset())
            mask = 0
            for p in took:
                mask |= tails.get(p, 0)
            key = (then, mask)
            if key not in ids:
                ids[key] = len(sets)
                sets.append(then)
                bits.append(mask)
            row.append(ids[key])
        row.append(0)
        rows.append(row)
    table, marks = np.array(rows), np.array(bits)
    groups = np.unique(marks, return_inverse=True)[1]
    while True:  # partition refinement: states stay together while their marks and their successors' groups agree
        finer = np.unique(np.column_stack((groups, groups[table])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == groups.max():
            break
        groups = finer
    some = {g: s for s, g in reversed(list(enumerate(groups.tolist())))}
    order = sorted(some, key=lambda g: (marks[some[g]] != 0, some[g] != 0, g))
    name = {g: i for i, g in enumerate(order)}
    if groups[0] != order[0]:
        raise ValueError("a rule must not match the empty text")
    small = np.array([[name[g] for g in groups[table[some[g]]]] for g in order])
    accepts = tuple(int(marks[some[g]]) for g in order)
    dead = next((i for i, row in enumerate(small.tolist()) if i and not accepts[i] and set(row[:-1]) == {i}), -1)
    return Automaton(small.ravel().astype(np.int32), class_of, classes, sum(not a for a in accepts), accepts, dead)


def scan(auto: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the last byte) and states at which the automaton accepts, for one pass over ``data``."""
    length = max(64, -(-len(data) // LANES))
    lanes = -(-len(data) // length)
    cells = np.full(lanes * length, END, np.uint8)
    cells[: len(data)] = data
    cls = np.ascontiguousarray(auto.class_of[cells].reshape(lanes, length).T)
    seen = np.empty((length, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(length):
        state = auto.next[state * auto.classes + cls[t]]
        seen[t] = state
    begun = np.zeros(lanes, np.int32)
    while True:
        real = np.concatenate(([0], seen[-1, :-1])).astype(np.int32)
        lane = np.flatnonzero(real != begun)
        if not len(lane):
            break
        begun[lane] = real[lane]
        state = real[lane]
        for t in range(length):
            state = auto.next[state * auto.classes + cls[t, lane]]
            apart = seen[t, lane] != state
            if not apart.any():
                break
            lane, state = lane[apart], state[apart]
            seen[t, lane] = state
    t, lane = np.nonzero(seen >= auto.first_accept)
    at = lane * length + t
    order = np.argsort(at)
    return at[order], seen[t, lane][order]


def run(auto: Automaton, data: bytes, at: int, step: int, stop: int) -> int | None:
    """The furthest place (exclusive) to which the automaton accepts, walking from ``at`` by ``step`` to ``stop``."""
    state, best, follow, class_of, classes = 0, None, auto.next, auto.class_of, auto.classes
    while at != stop:
        state = follow[state * classes + class_of[data[at]]]
        at += step
        if state >= auto.first_accept:
            best = at
        elif state == auto.dead:
            break
    return best


@functools.cache
def automata(rules: tuple[str, ...]) -> tuple[Automaton, list[Automaton], list[Automaton]]:
    begins = [BEGINS.get(r, r) for r in rules]
    return compile_rules(begins, True), [compile_rules([r], False) for r in rules], [compile_rules([r], False, True) for r in begins]


def short_value(match: bytes) -> bool:
    """Whether the value of an assignment has fewer than VALUE_LENGTH characters."""
    cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[cut + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) < VALUE_LENGTH


def credible(kind: str, data: bytes, start: int, end: int) -> bool:
    """Whether a match counts. A key of the further kinds doesn't begin within a word ("risk-...", "TASK0123"); one that is
    known by ``sk-`` alone also has a tenth of digits and capitals, which words joined by hyphens lack. A match that doesn't
    count still takes its text, as short values do."""
    if kind == "assign":
        return not short_value(data[start:end])
    if kind in ALONE and start and data[start - 1] in WORD_BYTES:
        return False
    return kind != "sk_key" or 10 * sum(b in MIXED_BYTES for b in data[start + 3 : end]) >= end - start - 3


def find_all(texts: list[str | None], kinds: dict[str, str], compiled: tuple | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its matches (start, rule number, end) in code points, in order of start, then rule."""
    combined, forward, backward = compiled or automata(tuple(kinds.values()))
    raw = [(x or "").encode("utf-8", "replace") for x in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    places, states = scan(combined, np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8))
    out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
    owners = np.searchsorted(ends, places, "right")
    taken: dict[tuple[int, int], int] = {}
    for doc, place, state in zip(owners.tolist(), places.tolist(), states.tolist(), strict=True):
        data, base = raw[doc], int(ends[doc]) - len(raw[doc]) - 1
        for rule in range(len(forward)):
            if combined.accepts[state] >> rule & 1 and place - base >= (low := taken.get((doc, rule), 0)):
                start = run(backward[rule], data, place - base, -1, low - 1)
                if start is None:  # it would begin within the match before
                    continue
                start += 1
                end = run(forward[rule], data, start, 1, len(data))
                if end is None:  # only the beginning of a match
                    continue
                taken[doc, rule] = end
                out[doc].append((start, rule, end))
    names = list(kinds)
    for doc, found in enumerate(out):
        if found:
            data = raw[doc]
            found[:] = sorted((s, r, e) for s, r, e in found if credible(names[r], data, s, e))
            if not data.isascii():  # bytes to code points
                before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                found[:] = [(int(before[s]), r, int(before[e])) for s, r, e in found]
    return out


def scan_documents(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end in code points) of every row; null and empty texts have none. Texts are read whole,
    however long; repeated rows are scanned apart, an empty table gives an empty result, other columns are not read."""
    kinds = rules or BASE_RULES | MORE_RULES
    small_batches(docs.sparkSession)
    compiled = docs.sparkSession.sparkContext.broadcast(automata(tuple(kinds.values())))  # transition arrays: under 1 MB

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(kinds)
        for frame in frames:
            found = find_all(frame["text"].tolist(), kinds, compiled.value)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": [[(names[r], s, e) for s, r, e in x] for x in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
