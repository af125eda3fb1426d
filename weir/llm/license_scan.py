"""License scans with template markup.

A template is licence wording in which `[[ ... ]]` marks an optional region (it may nest) and `<<name:n>>` a
replaceable one of 0 to n words. It is compiled into an automaton over word tokens: mandatory words are exact
transitions, optional regions are skips, and replaceable ones are counted runs of any word. A text is accepted at a
place where the automaton passes from its first to its last state over consecutive words, so that all mandatory
wording matches exactly. Every place of a text is tried; of the templates accepted from one start the longest acceptance counts
(base phrases always do).

Words are the runs of other characters than ASCII punctuation, space and control ones, A-Z lower-cased.

Defined results: a null or empty text has no words and no labels; repeated rows give repeated rows; other columns
don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, licences

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARKUP = re.compile(r"\[\[|\]\]|<<(\w+):(\d+)>>|[^\[\]<>\s]+|\S")

#: Phrases whose places count as base matches, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of short notices, and of whole licence texts and headers, with labels of the method's own.
TEMPLATES = (
    ("MIT-notice", "[[this <<what:3>> is]] [[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("Apache-2.0", "[[licensed under]] the apache license version 2 [[0]]"),
    ("GPL-notice", "[[this <<what:3>> is]] licensed under the [[gnu]] general public license [[version <<number:2>>]]"),
    ("GPL-3.0", "[[gnu]] general public license [[as published by the free software foundation either]] version 3"),
    ("GPL-2.0", "[[gnu]] general public license [[as published by the free software foundation either]] version 2"),
    ("LGPL", "[[gnu]] lesser general public license"),
    ("AGPL", "[[gnu]] affero general public license"),
    ("CC-BY", "licensed under [[a]] [[the]] [[creative commons]] cc by [[<<number:2>>]]"),
    ("CC-BY-NC", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[<<number:2>>]]"),
    ("CC-BY-SA", "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[<<number:2>>]]"),
    ("SPDX-tag", "spdx license identifier <<id:1>>"),
    *licences.TEXTS,
    *licences.bodies(),
)


@dataclass(frozen=True)
class Automaton:
    """steps[state]: (word or None for any word, next state); skips[state]: states reached without a word."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    closure: tuple[frozenset[int], ...]
    accept: int
    first: frozenset[bytes]

    def longest(self, words: Sequence[bytes], start: int) -> int:
        """The end of the longest acceptance that starts there, or -1."""
        states, at, end = self.closure[0], start, -1
        while states:
            if self.accept in states and at > start:
                end = at
            if at >= len(words):
                break
            word, after = words[at], set()
            for s in states:
                for need, to in self.steps[s]:
                    if need is None or need == word:
                        after |= self.closure[to]
            states, at = frozenset(after), at + 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    steps: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[list[int]] = [[]]

    def new() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    at, opened = 0, []
    for m in _MARKUP.finditer(template):
        token = m[0]
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            end = new()
            skips[at].append(end)
            skips[opened.pop()].append(end)
            at = end
        elif m[1]:
            end = new()
            skips[at].append(end)
            for _ in range(int(m[2])):
                after = new()
                steps[at].append((None, after))
                skips[after].append(end)
                at = after
            at = end
        else:
            for word in WORDS.findall(token.encode().lower()):
                after = new()
                steps[at].append((word, after))
                at = after
    if opened:
        raise ValueError(f"{label}: [[ without ]]")
    closure = []
    for s in range(len(steps)):
        seen, todo = {s}, [s]
        while todo:
            for t in skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closure.append(frozenset(seen))
    starts = [need for s in closure[0] for need, _ in steps[s]]
    if None in starts or not starts or len(steps) - 1 in closure[0]:
        raise ValueError(f"{label}: a template starts with a word and isn't empty")
    return Automaton(label, tuple(map(tuple, steps)), tuple(closure), len(steps) - 1, frozenset(starts))


class Scanner:
    """All automata, by their possible first words."""

    def __init__(self, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.by_word: dict[bytes, list[tuple[bool, Automaton]]] = {}
        for is_base, entries in ((True, ((label, phrase) for phrase, label in base)), (False, templates)):
            for label, text in entries:
                a = compile_template(label, text)
                for w in a.first:
                    self.by_word.setdefault(w, []).append((is_base, a))
        # A word that every template has to contain somewhere rules most texts out at once.
        self.needs = self._needed()

    def _needed(self) -> re.Pattern[bytes]:
        rare = set()
        for entries in self.by_word.values():
            for _, a in entries:
                mandatory = [w for w in {need for s in a.steps for need, _ in s if need} if not self._skippable(a, w)]
                rare.add(max(mandatory, key=lambda w: (len(w), w)) if mandatory else min(a.first))
        return re.compile(b"|".join(sorted(re.escape(w) for w in rare)))

    @staticmethod
    def _skippable(a: Automaton, word: bytes) -> bool:
        seen, todo = set(a.closure[0]), list(a.closure[0])
        while todo:
            for need, to in a.steps[todo.pop()]:
                if need != word:
                    for t in a.closure[to] - seen:
                        seen.add(t)
                        todo.append(t)
        return a.accept in seen

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """The number of words, and matches (label, is_base, first word, word after the last)."""
        low = text.lower()
        words = WORDS.findall(low)
        if not self.needs.search(low):
            return len(words), []
        found = []
        for w, entries in self.by_word.items():
            if w not in low:
                continue
            at = -1
            while True:
                try:
                    at = words.index(w, at + 1)
                except ValueError:
                    break
                here = [(a.label, is_base, at, end) for is_base, a in entries if (end := a.longest(words, at)) >= 0]
                reach = max((m[3] for m in here if not m[1]), default=0)
                found += [m for m in here if m[1] or m[3] == reach]
        return len(words), sorted(found, key=lambda m: (m[2], m[3], m[0]))


SCHEMA = "n_words long, matches array<struct<label string, is_base boolean, first long, after long>>, score double"


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, matches (the spans in words), score: the share of the words that stand in a match."""
    common.tune(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            ids, counts, spans, scores = batch.column(0), [], [], []
            raw, at = common.utf8(batch.column(1))
            for k in range(len(ids)):
                n, found = scanner.scan(raw[at[k] : at[k + 1]].tobytes())
                counts.append(n)
                spans.append([{"label": x[0], "is_base": x[1], "first": x[2], "after": x[3]} for x in found])
                covered, reach = 0, 0
                for _, _, lo, hi in found:
                    covered += max(0, hi - max(lo, reach))
                    reach = max(reach, hi)
                scores.append(covered / n if n else 0.0)
            span = pa.list_(pa.struct([("label", pa.string()), ("is_base", pa.bool_()), ("first", pa.int64()), ("after", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(scores, pa.float64())], ["id", "n_words", "matches", "score"])

    return rows.mapInArrow(common.lean(run), f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)
