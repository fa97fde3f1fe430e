"""License scans: templates with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Words, slices, words

#: Bytes that part words: all but digits, letters and the bytes of characters beyond ASCII.
PARTS = np.ones(256, dtype=bool)
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and their labels (fixed by the query's contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates: ``[[...]]`` may be left out, ``{{n}}`` stands for up to n words. Public license wordings (fixed values).
TEMPLATES = {
    "mit-grant": "[[is ]]released under the [[terms of the ]]MIT license",
    "mit-text": """Permission is hereby granted, [[free of charge, ]]to any person obtaining a copy of this software and associated documentation files
[[(the "Software")]], to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [[(including the next paragraph) ]]shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "apache-2.0-grant": "licensed under the Apache license, version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 [[(the "License")]]; you may not use {{6}} except in compliance with the License.
You may obtain a copy of the License at [[{{8}}]] Unless required by applicable law or agreed to in writing, [[software ]]distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied""",
    "gpl-3.0-grant": "licensed under the [[terms of the ]][[GNU ]]General Public License, version 3",
    "gpl-notice": """is free software[[: you can redistribute it]][[; you can redistribute it]] and/or modify it under the terms of the GNU {{2}} General Public License
as published by the Free Software Foundation[[, either]][[;]] version {{1}} of the License[[, or (at your option) any later version]]""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1. ]]Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2. ]]Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution""",
    "isc-text": """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies""",
}


def template_words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(markup: str) -> list:
    """A template as a list of words, ints (up to so many words) and lists (optional regions)."""
    stack: list[list] = [[]]
    for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", markup):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            if len(stack) < 2:
                raise ValueError("a region ends that didn't begin")
            region = stack.pop()
            stack[-1] += [region] if region else []
        elif part.startswith("{{"):
            stack[-1].append(int(part[2:-2]))
        else:
            stack[-1] += template_words(part)
    if len(stack) > 1 or not any(isinstance(x, str) for x in stack[0]):
        raise ValueError("a region doesn't end, or no word is mandatory")
    while not isinstance(stack[0][0], str):  # a match may begin anywhere, so regions before the first mandatory word decide nothing
        stack[0].pop(0)
    return stack[0]


def pattern(parts: list) -> str:
    """The same language as a regular expression over words that each follow a space (for SQL)."""
    return "".join(f" {p}" if isinstance(p, str) else f"(?: [^ ]+){{0,{p}}}" if isinstance(p, int) else f"(?:{pattern(p)})?" for p in parts)


class Automaton:
    """Positions are bits: bit p is on where the words so far lead to position p; the last position accepts.

    A word moves on the positions that take it (``takes``) or take any word (``anything``); ``jumps``
    leads from a position past the optional words behind it, as often as regions allow.
    """

    def __init__(self, markup: str):
        self.takes: dict[bytes, int] = {}
        self.anything, self.size, self.parts = 0, 0, parse(markup)
        skips: list[tuple[int, int]] = []
        self._add(self.parts, skips)
        self.accept = 1 << self.size
        self.jumps = {}
        for at, to in sorted(skips, reverse=True):  # later positions first, so what they reach is known
            self.jumps[at] = self.jumps.get(at, 0) | 1 << to | self.jumps.get(to, 0)
        self.jumping = sum(1 << p for p in self.jumps)
        self.lead = []
        for part in self.parts:
            if not isinstance(part, str) or len(self.lead) == 4:
                break
            self.lead.append(part)

    def _add(self, parts: list, skips: list[tuple[int, int]]) -> None:
        for part in parts:
            begin = self.size
            if isinstance(part, str):
                word = part.encode()
                self.takes[word] = self.takes.get(word, 0) | 1 << begin
                self.size += 1
            elif isinstance(part, int):
                self.size += part
                self.anything |= (1 << self.size) - (1 << begin)
                skips += [(at, self.size) for at in range(begin, self.size)]
            else:
                self._add(part, skips)
                skips.append((begin, self.size))

    def _closed(self, on: int) -> int:
        jump = on & self.jumping
        while jump:
            low = jump & -jump
            on |= self.jumps[low.bit_length() - 1]
            jump ^= low
        return on

    def accepts(self, text: Iterator[bytes]) -> bool:
        """Whether some first words of ``text`` are a wording of the template."""
        on = self._closed(1)
        for word in text:
            on = self._closed((on & (self.takes.get(word, 0) | self.anything)) << 1)
            if on & self.accept or not on:
                break
        return bool(on & self.accept)


def _places(w: Words, phrase: list[str]) -> np.ndarray:
    """Words from which the phrase's words stand consecutively in one text."""
    want = words(pa.array([" ".join(phrase)])).hash
    at = np.flatnonzero(w.hash == want[0])
    last = np.repeat(w.ptr[1:], np.diff(w.ptr))
    for k, h in enumerate(want[1:], 1):
        at = at[at + k < last[at]]
        at = at[w.hash[at + k] == h]
    exact = [p.encode() for p in phrase]
    return at[[all(_word(w, i + k) == e for k, e in enumerate(exact)) for i in at]] if len(at) else at


def _word(w: Words, i: int) -> bytes:
    return w.data[w.start[i] : w.end[i]].tobytes()


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(column: pa.Array, automata: dict[str, Automaton]) -> dict[str, pa.Array]:
    """The columns of a result for a slice of texts."""
    w = words(column, lower=True, space=PARTS)
    n, text = len(w.ptr) - 1, w.text
    base = {label: _places(w, phrase.split()) for phrase, label in PHRASES.items()}
    labels: list[set[str]] = [set() for _ in range(n)]
    for label, at in base.items():
        for t in np.unique(text[at]):
            labels[t].add(label)
    known = [",".join(sorted(x)) for x in labels]
    found = np.zeros(n, dtype=bool)
    for label, automaton in automata.items():
        for i in _places(w, automaton.lead):
            t = text[i]
            if label not in labels[t] and automaton.accepts(_word(w, k) for k in range(i, w.ptr[t + 1])):
                labels[t].add(label)
                found[t] = True
    hits = np.sort(np.concatenate(list(base.values())))
    count = np.bincount(text[hits], minlength=n)
    none = count == 0
    first, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    place = w.place[hits]
    last[text[hits]] = place  # ascending: the last one stays
    first[text[hits][::-1]] = place[::-1]
    return {
        "n_words": pa.array(np.diff(w.ptr).astype(np.int64)), "n_base": pa.array(count.astype(np.int64)),
        "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "base_labels": pa.array(known, pa.string()),
        "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()), "score": pa.array(np.where(found, 1.0, np.where(none, 0.0, 0.5))),
    }


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, words, base phrases and the labels of the templates whose wording it holds.

    A template's label is set where a text holds all its mandatory words in order, with nothing between them but its optional regions,
    whole, and words of its replaceable ones. ``score``: 1 with a template, 0.5 with base phrases alone, else 0. Null and
    empty texts have no words, empty labels and score 0; repeated rows and rows without an id are rows like any; other columns
    are ignored. Nothing is shuffled: a task holds an Arrow batch and works on a megabyte of text (or one longer text) at a time.
    """
    automata = {label: Automaton(markup) for label, markup in templates.items()}
    clash = [label for label in automata if label in PHRASES.values() or "," in label]
    if clash:
        raise ValueError(f"labels of templates must be their own, without commas: {clash}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({id_col: part.column("id"), **scan(part.column("text"), automata)})

    thin = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return thin.mapInArrow(run, f"`{id_col}` {thin.schema['id'].dataType.simpleString()}, {_OUT}")


def op11_licenses(docs: DataFrame) -> DataFrame:
    """All documents against all templates."""
    return scan_licenses(docs)


def _sql() -> str:
    """The templates as regular expressions over each text's words."""
    places = " || ".join(
        f"list_transform(list_filter(range(1, len(l) + 1), lambda i: l[i:i + {len(p.split()) - 1}] = {p.split()}), lambda i: {{'at': i - 1, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{pattern(Automaton(markup).parts)}(?: |$)') THEN '{label}' END" for label, markup in TEMPLATES.items())
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
p AS (SELECT doc_id, len(l) AS n_words, {places} AS b, ' ' || array_to_string(l, ' ') AS t FROM w), m AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS f, list_transform(b, lambda x: x.label) AS own FROM p)
SELECT doc_id, n_words, len(b) AS n_base, list_min(list_transform(b, lambda x: x.at)) AS first_word, list_max(list_transform(b, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(own)), ',') AS base_labels, array_to_string(list_sort(list_distinct(own || f)), ',') AS labels, CASE WHEN len(f) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM m"""


SQL = _sql()
