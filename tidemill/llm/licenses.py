"""License scan by template-markup matching.

A template is license wording with ``<<optional>> ... <<end>>`` regions, which a text may leave out, and
``<<var N>>`` regions, which stand for up to N words of any kind (names, years, versions). Templates are compiled
together into one automaton over word tokens: optional regions become empty steps, replaceable ones become steps on any
word. It runs over a text's words from each place where some template can begin; a template is accepted where all its
mandatory words have been read in order, exactly. Matching goes by words, so case, punctuation and line breaks of the
wording don't count. A run that ends early tells what share of a template's mandatory words the text holds. Phrases are
templates without markup. The wording is in ``license_texts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import LOWER_BYTES, small_batches
from .license_texts import all_templates

#: Phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Lower-case letters, digits and everything beyond ASCII stay, the rest separates words.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER_BYTES)


@dataclass
class TokenAutomaton:
    """Deterministic: ``steps[state]`` maps a word to a state, ``other[state]`` is the state for words not named there.

    ``accepts[state]`` holds the labels of the templates complete in it, ``share[state]`` the greatest share of a template's
    mandatory words that has been read in it; -1 is no state.
    """

    steps: list[dict[bytes, int]] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    accepts: list[tuple[str, ...]] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], float]:
        """(label, first word, words) of every accepted place, of one label and start the longest; and the greatest share
        of a template's mandatory words that stands anywhere."""
        begins, out, best = self.steps[0], {}, 0.0
        if begins.keys().isdisjoint(words):
            return [], 0.0
        for start in [i for i, w in enumerate(words) if w in begins]:
            state, at = 0, start
            while at < len(words):
                state = self.steps[state].get(words[at], self.other[state])
                if state < 0:
                    break
                at += 1
                best = max(best, self.share[state])
                for label in self.accepts[state]:
                    out[label, start] = at - start
        return [(label, start, n) for (label, start), n in out.items()], best


def places_of(template: str) -> list[tuple[bytes | None, list[int], int]]:
    """The places of a template: (word, places that may follow at once, mandatory words before). None is any word, the empty
    word begins an optional region."""
    places: list[tuple[bytes | None, list[int], int]] = []
    opened, mandatory = [], 0
    for part in re.findall(r"<<[^<>]*>>|(?:(?!<<[^<>]*>>).)+", template, re.DOTALL):
        if part == "<<optional>>":
            opened.append(len(places))
            places.append((b"", [], mandatory))
        elif part == "<<end>>":
            places[opened.pop()][1].append(len(places))
        elif part.startswith("<<var "):
            n = int(part[6:-2])
            for i in range(n):
                places.append((None, [len(places) - i + n], mandatory))
        else:
            for word in words_of(part):
                places.append((word, [], mandatory))
                mandatory += not opened
    places.append((b"", [], mandatory))
    return places


def compile_templates(templates: dict[str, str], phrases: dict[str, str] | None = None) -> TokenAutomaton:
    """Subset construction over (template, place); empty steps lead over optional and replaceable regions. Templates and
    ``phrases`` are accepted alike; only templates have shares."""
    labels = [*templates, *(phrases or {})]
    places = [places_of(t) for t in [*templates.values(), *(phrases or {}).values()]]

    def closed(points: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo, done = list(points), set()
        while todo:
            t, i = todo.pop()
            if (t, i) in done:
                continue
            done.add((t, i))
            word, follow, _ = places[t][i]
            todo += [(t, j) for j in follow] + ([(t, i + 1)] if word == b"" and i + 1 < len(places[t]) else [])
        return frozenset(done)

    sets = [closed({(t, 0) for t in range(len(places))})]
    ids, out = {sets[0]: 0}, TokenAutomaton()
    for now in sets:  # grows while it is read
        by_word: dict[bytes, set[tuple[int, int]]] = {}
        anything: set[tuple[int, int]] = set()
        for t, i in now:
            word = places[t][i][0]
            if word is None:
                anything.add((t, i + 1))
            elif word:
                by_word.setdefault(word, set()).add((t, i + 1))

        def state(points: set[tuple[int, int]]) -> int:
            if not points:
                return -1
            key = closed(points)
            if key not in ids:
                ids[key] = len(sets)
                sets.append(key)
            return ids[key]

        out.other.append(state(anything))
        out.steps.append({w: state(anything | by_word[w]) for w in sorted(by_word)})
        out.accepts.append(tuple(sorted(labels[t] for t, i in now if i == len(places[t]) - 1)))
        out.share.append(max((places[t][i][2] / max(places[t][-1][2], 1) for t, i in now if t < len(templates)), default=0.0))
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, start, words; templates and phrases) and share (of the mandatory words of the template
    of which most stands in the text; 1 where one is accepted) of every row.

    Null and empty texts have no word and no place; texts are read whole, however long; repeated rows are scanned apart; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    compiled = compile_templates(all_templates() if templates is None else templates, {f"phrase {p}": p for p in PHRASES})
    shared = spark.sparkContext.broadcast(compiled)  # a few megabytes

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = shared.value
        for frame in frames:
            counts, places, shares = np.zeros(len(frame), np.int64), [], np.zeros(len(frame))
            for i, text in enumerate(frame["text"].tolist()):
                words = words_of(text)
                counts[i] = len(words)
                found, shares[i] = auto.matches(words)
                places.append(found)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": counts, "places": places, "share": shares})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(find, f"doc_id {kind}, n_words bigint, places array<struct<label:string,start:bigint,words:bigint>>, share double")
