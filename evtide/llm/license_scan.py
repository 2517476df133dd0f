r"""License scan by an exact set-similarity join of text blocks and templates.

Every text is lower-cased (A-Z) and cut into words. Exact phrases are found
where their words stand in a row. For the join, a block is any ``BLOCK_WORDS``
consecutive words of the whole text, whatever lines they stand on, so a wrapped
notice is no different from one on a single line; for a template of more than
half as many words, blocks are twice the template's length. A block matches a template if
it holds at least ``ceil(threshold * n)`` of the template's n distinct words.
All matching pairs are found, first for the text as a whole:

* the words of the templates are ordered by how many documents hold them,
  counted over the whole table, rarest first;
* prefix filter: block and template must share a word among the first
  ``n - need + 1`` of the template; an inverted index over those words gives
  the pairs to look at (most texts hold none of them and are done);
* length filter: a text must have ``need`` template words at all;
* positional filter: a shared word at place i of the template and j of the
  text leaves at most ``1 + min(rest of template, rest of text)`` in common;
* for pairs that pass, the block slides over the places of the template's words
  and its distinct words are counted exactly.

Sibling licenses differ in a word or two, so containment alone confuses them. A
block must also hold the words that tell the template's license from others
(``KEY_WORDS``), and where licenses of the template's family are named in it, the
template's own must be among them (``license_names``): "CC BY-SA 4.0" is no
cc-by, "GNU General Public License" no lgpl.

The templates are a parameter of the job, a few hundred words held by every
task (or a table of whole texts, ``templates_of``); texts stay where they are read,
and only the word counts (one row per template word and batch) are shuffled. Tags
that name a license outright (``TAGS``: SPDX identifiers, addresses) take part in the
join with all their words, and must stand word by word to count.

Defined results: a null or empty text has no words and no label. Rows are
judged one by one; an empty table gives no rows. A text of any length is one row of
words, over which blocks slide word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import map_batches

BLOCK_WORDS = 100
THRESHOLD = 0.85
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")

# The phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl"))
# Public notices of common licenses: (label, text).
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License you may obtain "
               "a copy of the License at www apache org licenses"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)
_CC = "Licensed under a Creative Commons Attribution-{} 4.0 International License"
# Siblings of the above, in their short and long forms.
SIBLINGS = (
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", _CC.format("NonCommercial")),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", _CC.format("ShareAlike")),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd", _CC.format("NoDerivatives")),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", _CC.format("NonCommercial-ShareAlike")),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd", _CC.format("NonCommercial-NoDerivatives")),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
)
# More public notices and clauses.
NOTICES = (
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list "
            "of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be "
            "used to endorse or promote products derived from this software without specific "
            "prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
            "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies"),
    ("mit", "The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("epl", "This program and the accompanying materials are made available under the terms of "
            "the Eclipse Public License"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no "
             "event will the authors be held liable for any damages arising from the use of "
             "this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related "
            "or neighboring rights to this work"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the "
             "terms of the GNU Lesser General Public License"),
)
# License identifiers of SPDX and their labels, and the Creative Commons licenses by
# the path of their address.
SPDX = {"mit": ("MIT",), "apache": ("Apache-2.0",), "gpl": ("GPL-2.0", "GPL-3.0"),
        "lgpl": ("LGPL-2.1", "LGPL-3.0"), "agpl": ("AGPL-3.0",),
        "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "mpl": ("MPL-2.0",), "isc": ("ISC",),
        "epl": ("EPL-1.0", "EPL-2.0"), "unlicense": ("Unlicense",), "zlib": ("Zlib",),
        "cc0": ("CC0-1.0",)}
_CC_PATHS = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
# Marks that name a license outright: their words must stand in a row.
TAGS = (
    *((label, f"SPDX-License-Identifier: {i}") for label, ids in SPDX.items() for i in ids),
    *((f"cc-{p}", f"SPDX-License-Identifier: CC-{p}-{v}") for p in _CC_PATHS for v in _CC_VERSIONS),
    *((f"cc-{p}", f"creativecommons.org/licenses/{p}/{v}")
      for p in _CC_PATHS for v in _CC_VERSIONS),
    ("cc0", "creativecommons.org/publicdomain/zero/1.0"),
)
# Words without which a passage is not the license whose template holds them.
KEY_WORDS = frozenset(("mit", "apache", "mozilla", "eclipse", "unencumbered"))
# Words that make a Creative Commons or GNU license another one.
_CC_MARKS = {("nc",): "nc", ("noncommercial",): "nc", ("non", "commercial"): "nc",
             ("sa",): "sa", ("sharealike",): "sa", ("share", "alike"): "sa",
             ("nd",): "nd", ("noderivatives",): "nd", ("noderivs",): "nd",
             ("no", "derivatives"): "nd", ("no", "derivs"): "nd",
             ("no", "derivative", "works"): "nd"}
_GNU_MARKS = {"lesser": "lesser", "library": "lesser", "affero": "affero"}
_GNU_SHORT = {"lgpl": "lesser", "agpl": "affero"}
_NAMED = frozenset(("cc", "commons", "by", "attribution", "general", "gpl", *_GNU_SHORT))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower(text or ""))


def lower(text: str) -> str:
    """A-Z to a-z only: bytes.lower knows no other letters."""
    return text.encode().lower().decode()


def license_names(words: list[str]) -> list[tuple[int, int, str, frozenset[str]]]:
    """(first word, end, family, marks) of the Creative Commons and GNU licenses
    named in a text: "CC BY-NC 4.0" is a cc with the mark nc."""
    out, n = [], len(words)
    if _NAMED.isdisjoint(words):
        return out
    i = 0
    while i < n:
        start, w = i, words[i]
        i += 1
        if w not in _NAMED:
            continue
        if w == "gpl" or (w == "general" and i < n and words[i] == "public"):
            mark = _GNU_MARKS.get(words[start - 1]) if start else None
            i += w == "general"
            out.append((start - bool(mark), i, "gnu", frozenset([mark] if mark else [])))
        elif w in _GNU_SHORT:
            out.append((start, i, "gnu", frozenset([_GNU_SHORT[w]])))
        elif w != "general":
            plain = False
            if w in ("cc", "commons") and i < n and words[i] in ("by", "attribution"):
                plain, i = True, i + 1
            marks = set()
            while size := next((m for m in (1, 2, 3) if tuple(words[i:i + m]) in _CC_MARKS), 0):
                marks.add(_CC_MARKS[tuple(words[i:i + size])])
                i += size
            if plain or marks:
                out.append((start, i, "cc", frozenset(marks)))
    return out


def vocabulary(templates) -> frozenset[str]:
    return frozenset(w for _, t in templates for w in words_of(t))


def word_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, over the whole table.

    At most one row per template word reaches the driver.
    """
    vocab = vocabulary(templates)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            n.update(vocab.intersection(words_of(text)))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
            names=["word", "n"])
    rows = (map_batches(docs.select("text"), run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    return {r.word: r.n for r in rows}


@dataclass(frozen=True)
class _Template:
    label: str
    order: tuple[str, ...]      # distinct words, rarest first
    need: int
    words: int                  # with repeats
    exact: tuple[str, ...]      # a tag's words, which must stand in a row
    keys: frozenset[str]        # words that a passage must hold
    names: frozenset[tuple[str, frozenset[str]]]    # family and marks it names


class Named:
    """Whether blocks, in text order, name what a template names."""

    def __init__(self, wanted, names):
        families = {f for f, _ in wanted}
        self.wanted = wanted
        self.names = [n for n in names if n[2] in families]
        self.first = self.end = 0
        self.inside: Counter = Counter()

    def fit(self, start: int, end: int) -> bool:
        """Each license that the template names is named in the block, or it
        has no marks and the block, from start to end, names none of its family.
        A name that adjoins the block counts: "GNU" may end it before "Lesser GPL"."""
        while self.end < len(self.names) and self.names[self.end][0] <= end:
            self.inside[self.names[self.end][2:]] += 1
            self.end += 1
        while self.first < self.end and self.names[self.first][1] < start:
            self.inside[self.names[self.first][2:]] -= 1
            self.first += 1
        for family, marks in self.wanted:
            if not self.inside[family, marks] and (
                    marks or any(n and f == family for (f, _), n in self.inside.items())):
                return False
        return True


class Joiner:
    """The template side of the join: prefix index over globally ordered words."""

    def __init__(self, templates, threshold: float, counts: dict[str, int], tags=()):
        self.rank = {w: k for k, w in enumerate(
            sorted(vocabulary([*templates, *tags]), key=lambda w: (counts.get(w, 0), w)))}
        self.templates = []
        self.index: dict[str, list[tuple[int, int]]] = {}
        for k, (label, text) in enumerate([*templates, *tags]):
            order = tuple(sorted(set(words_of(text)), key=self.rank.__getitem__))
            exact = tuple(words_of(text)) if k >= len(templates) else ()
            need = len(order) if exact else max(1, math.ceil(threshold * len(order) - 1e-9))
            for i, w in enumerate(order[:len(order) - need + 1]):
                self.index.setdefault(w, []).append((len(self.templates), i))
            self.templates.append(_Template(
                label, order, need, len(words_of(text)), exact, KEY_WORDS.intersection(order),
                frozenset(n[2:] for n in license_names(words_of(text)))))
        self.prefix = frozenset(self.index)
        self.least = min(t.need for t in self.templates) if self.templates else 0

    def block(self, words) -> dict[int, float]:
        """Templates that the block contains to the threshold, and how far."""
        held = sorted(self.rank.keys() & words, key=self.rank.__getitem__)
        out: dict[int, float] = {}
        if len(held) < self.least:
            return out
        for j, w in enumerate(held):
            for k, i in self.index.get(w, ()):
                t = self.templates[k]
                if k in out or len(held) < t.need:
                    continue
                if 1 + min(len(t.order) - 1 - i, len(held) - 1 - j) < t.need:
                    continue
                common = len(words & frozenset(t.order))
                if common >= t.need:
                    out[k] = common / len(t.order)
        return out

    def document(self, n_words: list[str],
                 size: int = BLOCK_WORDS) -> list[tuple[int, int, int, float]]:
        """(first word, words, template, containment) of every matching passage:
        overlapping blocks that match a template are one, and the first of
        those that hold most is given, from its first template word to its last."""
        if self.prefix.isdisjoint(n_words):
            return []
        near = self.block(frozenset(n_words))
        if not near:
            return []
        tags = [k for k in near if self.templates[k].exact]
        found = [(at, len(self.templates[k].exact), k, 1.0) for k in tags
                 for at, _ in phrase_places(n_words, [(" ".join(self.templates[k].exact), k)])]
        near = [k for k in near if not self.templates[k].exact]
        wanted = frozenset().union(*(self.templates[k].order for k in near))
        places = [(i, w) for i, w in enumerate(n_words) if w in wanted]
        names = (license_names(n_words) if any(self.templates[k].names for k in near) else [])
        return sorted(found + [m for k in near for m in self.slide(k, places, size, names)])

    def slide(self, k: int, places: list[tuple[int, str]], size: int, names):
        """The passages of template ``k``: the block ends at each of its words."""
        t = self.templates[k]
        size = max(size, 2 * t.words)
        own = frozenset(t.order)
        named = Named(t.names, names)
        held: Counter[str] = Counter()
        block: deque[tuple[int, str]] = deque()
        best, until = None, -1
        for i, w in places:
            if w not in own:
                continue
            block.append((i, w))
            held[w] += 1
            while block[0][0] <= i - size:
                _, old = block.popleft()
                held[old] -= 1
                if not held[old]:
                    del held[old]
            if len(held) < t.need or not all(w in held for w in t.keys):
                continue
            if not named.fit(i - size + 1, i + 1):
                continue
            if best and block[0][0] > until:
                yield best
                best = None
            until = i
            if not best or len(held) / len(t.order) > best[3]:
                best = (block[0][0], i - block[0][0] + 1, k, len(held) / len(t.order))
        if best:
            yield best


    def passages(self, n_words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, words, label, containment): of passages of one label that
        overlap, the one with the greatest containment, then the first."""
        out: list[tuple[int, int, str, float]] = []
        last: dict[str, tuple[int, int]] = {}       # label: its place in out, the end so far
        for start, size, k, share in self.document(n_words):
            label = self.templates[k].label
            at, end = last.get(label, (-1, -1))
            if start < end:
                if share > out[at][3]:
                    out[at] = (start, size, label, share)
                last[label] = (at, max(end, start + size))
            else:
                last[label] = (len(out), start + size)
                out.append((start, size, label, share))
        return sorted(out)


def phrase_places(words: list[str], phrases) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand in a row."""
    out = []
    for phrase, label in phrases:
        want = phrase.split()
        last, at = want[-1], -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            start = at - len(want) + 1
            if start >= 0 and words[start:at + 1] == want:
                out.append((start, label))
    return out


def templates_of(table: DataFrame, most: int = 5_000) -> tuple[tuple[str, str], ...]:
    """Templates of a table (label, text), whole license texts say; every task
    holds them, so a table of more than ``most`` rows is refused. Rows without
    a label or a word are passed over."""
    rows = table.select("label", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return tuple((r.label, r.text) for r in rows if r.label is not None and words_of(r.text))


def scan_licenses(docs: DataFrame, templates=TEMPLATES + SIBLINGS + NOTICES, phrases=PHRASES,
                  threshold: float = THRESHOLD, tags=TAGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels (sorted, comma-joined), score (1 where a
    phrase stands, else the largest containment of a match, else 0) and blocks
    (first word, words, label, containment of every matching passage)."""
    joiner = Joiner(templates, threshold, word_counts(docs, [*templates, *tags]), tags)
    block = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()),
                       ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()),
                        ("score", pa.float64()), ("blocks", pa.list_(block))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            base = phrase_places(words, phrases)
            found = joiner.passages(words)
            kinds = {label for _, label in base}
            more = kinds | {label for _, _, label, _ in found}
            rows.append((doc_id, len(words), len(base),
                         min((s for s, _ in base), default=None),
                         max((s for s, _ in base), default=None),
                         ",".join(sorted(kinds)), ",".join(sorted(more)),
                         1.0 if base else max((c for *_, c in found), default=0.0),
                         [{"first_word": s, "words": n, "label": label, "containment": c}
                          for s, n, label, c in found]))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return map_batches(
        docs.select("doc_id", "text"), run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, blocks array<struct<first_word:bigint,"
        "words:bigint,label:string,containment:double>>")
