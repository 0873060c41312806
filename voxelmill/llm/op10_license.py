"""License scans by template-markup matching.

A template is a licence's wording with regions marked ``<<opt>> ... <</opt>>`` (may
be left out) and ``<<any:min-max>>`` (may be replaced by so many words).  It is
compiled into an automaton over words; where the automaton accepts a run of a text's
words, all mandatory wording stands exactly, and the text gets the licence's label.
Of the runs that begin at one word the longest is taken, so optional regions at the
ends decide what belongs to the licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import read
from .textkit import ALNUM, Slab, gram_hashes, slabs, span_hashes, words

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_COPYRIGHT = "<<opt>> copyright <<opt>> c <</opt>> <<any:0-20>> <</opt>>"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_DEALINGS = "arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    <<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    <<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_TAIL = """this software is provided by <<any:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
    in no event shall <<any:1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
    or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
#: Whole licences and notices, by name: the licence's label and the template.
LICENSES = {
    "mit-text": (
        "mit",
        f"""<<opt>> the mit license <<opt>> mit <</opt>> <</opt>> {_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>>
        shall be included in all copies or substantial portions of the software {_AS_IS} and noninfringement
        in no event shall <<any:1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise {_DEALINGS}""",
    ),
    "bsd-2-text": ("bsd-2-clause", f"{_COPYRIGHT} <<opt>> all rights reserved <</opt>> {_BSD_HEAD} {_BSD_TAIL}"),
    "bsd-3-text": (
        "bsd-3-clause",
        f"""{_COPYRIGHT} <<opt>> all rights reserved <</opt>> {_BSD_HEAD}
        <<opt>> 3 <</opt>> neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_TAIL}""",
    ),
    "isc-text": (
        "isc",
        f"""<<opt>> isc license <</opt>> {_COPYRIGHT} permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:1-8>> disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall <<any:1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    ),
    "zlib-text": (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<opt>> 1 <</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
        an acknowledgment in the product documentation would be appreciated but is not required <<opt>> 2 <</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<opt>> 3 <</opt>> this notice may not be removed or altered from any source distribution""",
    ),
    "unlicense-text": (
        "unlicense",
        f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
        for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
        we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity
        of all present and future rights to this software under copyright law {_AS_IS} and noninfringement
        in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise {_DEALINGS} <<opt>> for more information please refer to <<any:1-4>> <</opt>>""",
    ),
    "boost-text": (
        "bsl-1.0",
        f"""<<opt>> boost software license version 1 0 <<any:0-6>> <</opt>> permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
        to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
        the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part
        and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
        {_AS_IS} title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise {_DEALINGS}""",
    ),
    "apache-2-notice": (
        "apache-2",
        f"""{_COPYRIGHT} licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:1-10>>
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    ),
    "gpl-notice": (
        "gpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu <<any:0-1>> general public license as published by the free software foundation
        either version <<any:1-1>> <<opt>> 0 <</opt>> of the license or <<opt>> at your option <</opt>> any later version this program is distributed in the hope that it will be useful but without any warranty
        without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<any:0-1>> general public license for more details
        you should have received a copy of the gnu <<any:0-1>> general public license along with this program""",
    ),
}
#: Statements that name a licence.
STATEMENTS = {
    "mit-named": ("mit", "<<opt>> released <</opt>> <<opt>> licensed <</opt>> <<opt>> distributed <</opt>> under the <<opt>> terms of the <</opt>> mit license"),
    "apache-2-named": ("apache-2", "<<opt>> licensed <</opt>> under the <<opt>> terms of the <</opt>> apache license <<opt>> version <</opt>> 2 <<opt>> 0 <</opt>>"),
    "bsd-2-named": ("bsd-2-clause", "under the <<opt>> terms of the <</opt>> bsd 2 clause license"),
    "bsd-3-named": ("bsd-3-clause", "under the <<opt>> terms of the <</opt>> bsd 3 clause license"),
    "gpl-named": ("gpl", "<<opt>> licensed <</opt>> under the <<opt>> terms of the <</opt>> gnu <<any:0-1>> general public license <<opt>> version <<any:1-1>> <</opt>>"),
    "cc-by-named": ("cc-by", "under <<opt>> a <</opt>> <<opt>> the <</opt>> creative commons attribution <<opt>> <<any:1-1>> 0 <</opt>> <<opt>> international <</opt>> license"),
    "cc-by-sa-named": ("cc-by-sa", "under <<opt>> a <</opt>> <<opt>> the <</opt>> creative commons attribution share alike <<opt>> <<any:1-1>> 0 <</opt>> <<opt>> international <</opt>> license"),
    "cc-by-nc-named": ("cc-by-nc", "<<opt>> licensed <</opt>> under <<opt>> a <</opt>> <<opt>> the <</opt>> cc by nc <<opt>> <<any:1-1>> 0 <</opt>> <<opt>> license <</opt>>"),
}
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARK = re.compile(r"<<opt>>|<</opt>>|<<any:(\d+)-(\d+)>>|[^\s<]+")


class Automaton:
    """Word automaton of a template: per state, exact words and wildcard steps to next states."""

    def __init__(self, template: str):
        self.on: list[dict[str, int]] = [{}]
        self.wild: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for m in _MARK.finditer(template):
            if m[0] == "<<opt>>":
                opened.append(at)
            elif m[0] == "<</opt>>":
                if not opened:
                    raise ValueError(f"<</opt>> without <<opt>> in {template!r}")
                self.skip[opened.pop()].append(at)
            elif m[1] is not None:
                low, high = int(m[1]), int(m[2])
                begun = []
                for k in range(high):
                    if k >= low:
                        begun.append(at)
                    nxt = self._state()
                    self.wild[at] = nxt
                    at = nxt
                for s in begun:
                    self.skip[s].append(at)
            else:
                nxt = self._state()
                self.on[at][m[0]] = nxt
                at = nxt
        if opened:
            raise ValueError(f"<<opt>> is not closed in {template!r}")
        self.final = at
        self.first = {w for s in self._closure({0}) for w in self.on[s]}
        if self.final in self._closure({0}) or any(self.wild[s] is not None for s in self._closure({0})):
            raise ValueError(f"a template must begin with wording: {template!r}")

    def _state(self) -> int:
        self.on.append({})
        self.wild.append(None)
        self.skip.append([])
        return len(self.on) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def longest_at(self, tokens: list[str], at: int) -> int | None:
        """Where the longest accepted run of words from ``at`` ends; None if none is accepted."""
        states, end = self._closure({0}), None
        while states:
            if self.final in states:
                end = at
            if at == len(tokens):
                break
            word = tokens[at]
            states = self._closure({t for s in states for t in (self.on[s].get(word), self.wild[s]) if t is not None})
            at += 1
        return end

    def starts(self) -> set[tuple[str, ...]]:
        """Word pairs with which an accepted run can begin (a single word where the second is free)."""
        out = set()
        for s in self._closure({0}):
            for w, t in self.on[s].items():
                nxt = self._closure({t})
                if self.final in nxt or any(self.wild[x] is not None for x in nxt):
                    out.add((w,))
                else:
                    out |= {(w, v) for x in nxt for v in self.on[x]}
        return out


@lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str, float, str], ...]) -> list[tuple[str, str, float, Automaton]]:
    return [(name, label, score, Automaton(t)) for name, label, score, t in templates]


def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(Slab(0, 1, raw, np.array([0, len(raw)])), np.array([0]), np.array([len(raw)]), fold=True)[0]


def _sequence_hash(tokens: tuple[str, ...]) -> np.uint64:
    h = np.array([_word_hash(w) for w in tokens])
    return h[0] if len(h) == 1 else gram_hashes(h, len(h))[0]


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, licenses: dict[str, tuple[str, str]] | None = None, statements: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Base places and labels of each row, the licences whose templates accept somewhere in its text, and where.

    ``labels`` are the base labels and those of the templates that accept; ``spans``
    are name:first word:end of the accepted runs, by first word, then name; a
    template's runs don't overlap.  ``score`` is 1 where a whole licence or notice
    stands, 0.75 where a statement does, 0.5 where only a base phrase does, else 0.

    A null, empty or wordless text has no places, null first and last words and
    empty labels.  Repeated rows and null doc_ids are rows like others, equal texts
    get equal results, an empty table gives no rows, other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    kinds = ((1.0, LICENSES if licenses is None else licenses), (0.75, STATEMENTS if statements is None else statements))
    rules = tuple((name, label, score, template) for score, named in kinds for name, (label, template) in named.items())

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(rules)
        by_length: dict[int, dict[int, str]] = {}
        for p, label in phrases.items():
            t = tuple(p.split())
            by_length.setdefault(len(t), {})[int(_sequence_hash(t))] = label
        openings: dict[int, list[int]] = {1: [], 2: []}
        for *_, a in automata:
            for s in a.starts():
                openings[len(s)].append(int(_sequence_hash(s)))
        openings = {n: np.unique(np.array(v, np.uint64)) for n, v in openings.items()}
        for batch in batches:
            for slab in slabs(batch.column(1)):
                w = words(slab, ALNUM)
                h = span_hashes(slab, w.start, w.end, fold=True)
                places: list[list[tuple[int, str]]] = [[] for _ in range(slab.n)]
                for n, labels in by_length.items():
                    grams = gram_hashes(h, n) if n > 1 else h
                    for at in np.flatnonzero(np.isin(grams, np.array(list(labels), np.uint64))):
                        r = int(w.row[at])
                        if at + n <= w.bound[r + 1]:
                            places[r].append((int(at - w.bound[r]), labels[int(grams[at])]))
                may_start = np.isin(h, openings[1])
                if len(h) > 1:
                    may_start[:-1] |= np.isin(gram_hashes(h, 2), openings[2])
                found: list[list[tuple]] = [[] for _ in range(slab.n)]
                starts = np.flatnonzero(may_start)
                for r in np.unique(w.row[starts]):
                    lo, hi = int(w.bound[r]), int(w.bound[r + 1])
                    base, raw = int(w.start[lo]), slab.buf[w.start[lo] : w.end[hi - 1]].tobytes()
                    tokens = [raw[a - base : b - base].decode("utf-8", "replace").translate(_LOWER) for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist())]
                    done: dict[str, int] = {}
                    for at in (starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo).tolist():
                        for name, label, score, a in automata:
                            if tokens[at] in a.first and at >= done.get(name, 0) and (end := a.longest_at(tokens, at)) is not None:
                                done[name] = end
                                found[r].append((at, name, end, label, score))
                base_labels = [sorted({x for _, x in p}) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(slab.first, slab.n),
                        pa.array(w.count()),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p)[0] if p else None for p in places], pa.int64()),
                        pa.array([max(p)[0] if p else None for p in places], pa.int64()),
                        pa.array([",".join(x) for x in base_labels]),
                        pa.array([",".join(sorted({f[3] for f in found[r]} | set(base_labels[r]))) for r in range(slab.n)]),
                        pa.array([max([f[4] for f in found[r]] + [0.5 if places[r] else 0.0]) for r in range(slab.n)], pa.float64()),
                        pa.array([",".join(f"{name}:{at}:{end}" for at, name, end, *_ in sorted(found[r])) for r in range(slab.n)]),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select("doc_id", text).mapInArrow(match, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def expression(template: str) -> str:
    """The template as a regular expression over words with a space after each, by rewriting its marks only."""
    out = re.sub(r"\s+", " ", template.strip()) + " "
    out = re.sub(r"<<any:(\d+)-(\d+)>> ", r"(?:[^ ]+ ){\1,\2}", out)
    return out.replace("<<opt>> ", "(?:").replace("<</opt>> ", ")?")


def _oracle() -> str:
    def found(named: dict[str, tuple[str, str]]) -> str:
        return ", ".join(f"CASE WHEN regexp_matches(joined, ' {expression(t)}') THEN '{label}' END" for label, t in named.values())

    base = "".join(f", CASE WHEN contains(joined, ' {p} ') THEN '{k}' END" for p, k in PHRASES.items())
    at = " OR ".join(f"w[i + 1 : i + {len(p.split())}] = {p.split()}" for p in PHRASES)
    return f"""
    WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, list_filter(range(0, len(w)), lambda i: {at}) AS places FROM t),
    v AS (SELECT doc_id, len(w) AS n_words, places, list_sort(list_distinct(list_filter([{base[2:]}], lambda x: x IS NOT NULL))) AS b,
        list_filter([{found(LICENSES)}], lambda x: x IS NOT NULL) AS whole, list_filter([{found(STATEMENTS)}], lambda x: x IS NOT NULL) AS said FROM u)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
        array_to_string(b, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(whole, said, b))), ',') AS labels,
        CASE WHEN len(whole) > 0 THEN 1e0 WHEN len(said) > 0 THEN 0.75e0 WHEN len(places) > 0 THEN 0.5e0 ELSE 0e0 END AS score FROM v"""


ORACLE_SQL = {"op10_license": _oracle()}
QUERIES = {"op10_license": op10_license}
