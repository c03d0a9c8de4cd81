"""Operator 1: license scans by template-markup matching.

A template is a license's wording with two kinds of markup, as in public license lists: optional regions
(``<<beginOptional>> ... <<endOptional>>``) and replaceable ones (``<<var;name=...;match=...>>``, where match
is ``.{a,b}`` for a to b words, ``number`` for a word of digits, or alternatives ``one|two words``).  It is
compiled into an automaton over words; a text is accepted from a place on if all mandatory words stand there
exactly, in order.  Automata start only where their rarest mandatory word (the anchor) is near, which loses
no match: every match holds the anchor at a bounded distance from its start.

Null and wordless texts have no words and no labels.  Repeated rows and ids give one row each.  Whole texts are
read, however long.  Of several ends of one template from one place the longest counts.  An empty table gives an empty
one.  Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, span_hashes, utf8, words

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
ANY, NUMBER = object(), object()

# The phrases every scan counts, and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

@cache
def templates() -> dict[str, list[str]]:
    """Label -> templates: one file of folder ``templates`` per label, its templates parted by lines of ``====``.

    The files hold wordings of public licenses and common notices (fixed values); short licenses stand there in
    full, long ones by their notices.
    """
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt")}
    return {k: [t.strip() for t in found[k].split("\n====\n")] for k in sorted(found)}


def parse(markup: str) -> list:
    """Nested list of words (str), ('opt', [...]), ('any', a, b), ('number',) and ('alt', [[...], ...])."""
    stack: list[list] = [[]]
    for m in _MARKUP.finditer(markup.translate({c: c + 32 for c in range(65, 91)}).replace("<<beginoptional", "<<beginOptional").replace("<<endoptional", "<<endOptional")):
        tag, word = m.groups()
        if word is not None:
            stack[-1].append(word)
        elif tag == "beginOptional":
            stack.append([])
        elif tag == "endOptional":
            done = stack.pop()
            stack[-1].append(("opt", done))
        else:
            match = dict(p.split("=", 1) for p in tag.split(";")[1:])["match"]
            if span := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
                stack[-1].append(("any", int(span[1]), int(span[2])))
            else:
                stack[-1].append(("number",) if match == "number" else ("alt", [a.split() for a in match.split("|")]))
    if len(stack) != 1:
        raise ValueError(f"optional region not closed: {markup[:60]}")
    return stack[0]


def lengths(parts: list) -> tuple[int, int]:
    """Fewest and most words that the parts can take."""
    lo = hi = 0
    for p in parts:
        if isinstance(p, str) or p[0] == "number":
            a = b = 1
        elif p[0] == "opt":
            a, b = 0, lengths(p[1])[1]
        elif p[0] == "any":
            a, b = p[1:]
        else:
            a, b = min(map(len, p[1])), max(map(len, p[1]))
        lo, hi = lo + a, hi + b
    return lo, hi


class Automaton:
    """A template as a nondeterministic automaton over words."""

    def __init__(self, label: str, markup: str, common: frozenset[str] = frozenset("the and of to in a is any with or for this under all by be".split())):
        self.label, parts = label, parse(markup)
        self.edges: list[list[tuple[object, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.final = self._build(parts, 0)
        fixed = [(w not in common, len(w), -i) for i, w in enumerate(parts) if isinstance(w, str)]
        if not fixed:
            raise ValueError("a template needs a mandatory word")
        i = -max(fixed)[2]
        #: Each match holds the anchor, this many words after its start.
        self.anchor, self.before = parts[i], lengths(parts[:i])
        self.start = self._closure({0})

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _build(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str) or p[0] == "number":
                to = self._state()
                self.edges[at].append((p if isinstance(p, str) else NUMBER, to))
            elif p[0] == "opt":
                end, to = self._build(p[1], at), self._state()
                self.free[at].append(to)
                self.free[end].append(to)
            elif p[0] == "any":
                to = self._state()
                for n in range(p[2] + 1):
                    if n >= p[1]:
                        self.free[at].append(to)
                    if n < p[2]:
                        step = self._state()
                        self.edges[at].append((ANY, step))
                        at = step
            else:
                to = self._state()
                for words_ in p[1]:
                    self.free[self._build(words_, at)].append(to)
            at = to
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)

    def match(self, text: list[str], at: int) -> int:
        """The end of the longest accepted run of words from at on; -1 if none is accepted."""
        now, end = self.start, -1
        for i in range(at, len(text) + 1):
            if self.final in now:
                end = i
            if i == len(text) or not now:
                break
            w = text[i]
            now = self._closure({to for s in now for want, to in self.edges[s] if want is ANY or want == w or want is NUMBER and w.isascii() and w.isdigit()})
        return end


def automata(markups: Mapping[str, Sequence[str]]) -> tuple[list[Automaton], list[Automaton]]:
    return [Automaton(k, v) for k, v in BASE.items()], [Automaton(k, v) for k, vs in markups.items() for v in vs]


def _anchor_hashes(anchors: list[str]) -> np.ndarray:
    raw = [a.encode() for a in anchors]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw], np.int64), ends)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per document: word and place counts, labels, score and the matched spans (label, start, end, in words).

    score is 1 if a whole template is accepted, 0.5 if only base phrases stand there, else 0.
    markups: label -> templates, those of the package if not given.
    """
    markups = {k: list(v) for k, v in (templates() if markups is None else markups).items()}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, full = automata(markups)
        by_anchor: dict[str, list[tuple[Automaton, bool]]] = {}
        for a, is_base in [(a, True) for a in base] + [(a, False) for a in full]:
            by_anchor.setdefault(a.anchor, []).append((a, is_base))
        distinct = np.unique(_anchor_hashes(list(by_anchor)))
        for whole in batches:
            for batch in slices(whole, 1):
                low, starts, ends, first = words(*utf8(batch.column(1)))
                h = span_hashes(low, starts, ends)
                near = np.flatnonzero(distinct[np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)] == h)
                spans: list[set] = [set() for _ in range(batch.num_rows)]
                places: list[list] = [[] for _ in range(batch.num_rows)]
                rows, cut = np.unique(np.searchsorted(first, near, side="right") - 1, return_index=True)
                for r, mine in zip(rows.tolist(), np.split(near, cut[1:])):
                    a, b = int(first[r]), int(first[r + 1])
                    text = [low[s:e].tobytes().decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    for at in (mine - a).tolist():
                        for one, is_base in by_anchor.get(text[at], ()):
                            for s in range(max(0, at - one.before[1]), at - one.before[0] + 1):
                                if (e := one.match(text, s)) > 0:
                                    spans[r].add((one.label, s, e, is_base))
                    places[r] = sorted(s for _, s, _, is_base in spans[r] if is_base)
                labels = [[",".join(sorted({x[0] for x in found if x[3] or not only})) for found in spans] for only in (True, False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                        pa.array([p[0] if p else None for p in places], pa.int64()), pa.array([p[-1] if p else None for p in places], pa.int64()),
                        pa.array(labels[0]), pa.array(labels[1]),
                        pa.array([1.0 if any(not x[3] for x in f) else 0.5 if f else 0.0 for f in spans]),
                        pa.array([[{"label": x[0], "start": x[1], "end": x[2]} for x in sorted(f)] for f in spans], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>")


def as_regex(parts: list) -> str:
    """The parts as a regular expression over words that each follow a space, for the SQL of tests."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f" {p}"
        elif p[0] == "number":
            out += " [0-9]+"
        elif p[0] == "opt":
            out += f"(?:{as_regex(p[1])})?"
        elif p[0] == "any":
            out += "(?: [^ ]+){%d,%d}" % p[1:]
        else:
            out += "(?:" + "|".join(as_regex(a) for a in p[1]) + ")"
    return out
