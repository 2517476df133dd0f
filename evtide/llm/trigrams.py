"""Boolean trigram queries for regular expressions, and their postings.

``query(pattern)`` reads the pattern's parse tree and returns what every match
must contain: a list (all of) of lists (any of) of trigram sets (all of).
Letters are folded to lower case, as the index is. A pattern that guarantees
no trigram gives an empty list: its rule scans everything.
"""

from __future__ import annotations

import re

import numpy as np

_P = re._parser
_MAX_STRINGS = 64
_MAX_CLASS = 4

Query = list[list[frozenset[bytes]]]


def _trigrams(s: str) -> frozenset[bytes]:
    b = s.lower().encode()
    return frozenset(b[i:i + 3] for i in range(len(b) - 2))


def _clause(strings: set[str]) -> list[frozenset[bytes]] | None:
    """Any of the strings' trigram sets, without those implied by a smaller
    one; None if some string has no trigram."""
    sets = {_trigrams(s) for s in strings}
    if frozenset() in sets:
        return None
    return sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)


def _class_strings(items) -> set[str] | None:
    out = set()
    for op, arg in items:
        if op is _P.LITERAL:
            out.add(chr(arg))
        elif op is _P.RANGE and arg[1] - arg[0] < _MAX_CLASS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= _MAX_CLASS else None


def _exact(tree) -> set[str] | None:
    """All strings that the tree matches, if they are few; else None."""
    strings = {""}
    for op, arg in tree:
        if op is _P.LITERAL:
            part = {chr(arg)}
        elif op is _P.IN:
            part = _class_strings(arg)
        elif op is _P.SUBPATTERN:
            part = _exact(arg[3])
        elif op is _P.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (_P.MAX_REPEAT, _P.MIN_REPEAT) and arg[1] <= 8:
            one = _exact(arg[2])
            part = None if one is None else _repeated(one, int(arg[0]), int(arg[1]))
        elif op is _P.AT:
            part = {""}
        else:
            part = None
        if part is None or len(strings) * len(part) > _MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in part}
    return strings


def _repeated(one: set[str], least: int, most: int) -> set[str] | None:
    out, run = set(), {""}
    for k in range(most + 1):
        if k >= least:
            out |= run
        run = {a + b for a in run for b in one}
        if len(run) + len(out) > _MAX_STRINGS:
            return None
    return out


def _walk(tree) -> Query:
    found: Query = []
    run: list = []

    def flush():
        strings = _exact(run) if run else None
        if strings and (c := _clause(strings)):
            found.append(c)
        run.clear()
    for node in tree:
        op, arg = node
        if _exact([*run, node]) is not None:
            run.append(node)
            continue
        flush()
        if _exact([node]) is not None:
            run.append(node)
        elif op is _P.SUBPATTERN:
            found += _walk(arg[3])
        elif op in (_P.MAX_REPEAT, _P.MIN_REPEAT) and arg[0] >= 1:
            found += _walk([*arg[2]] * min(int(arg[0]), 8))
        elif op is _P.BRANCH:
            # any branch: the first clause of each stands for it
            parts = [_walk(b) for b in arg[1]]
            if all(parts):
                found.append(sorted({s for p in parts for s in p[0]}, key=sorted))
    flush()
    return found


def query(pattern: str) -> Query:
    return _walk(_P.parse(pattern))


class Postings:
    """Postings of a shard of texts for a given vocabulary of trigrams."""

    def __init__(self, folded: list[bytes], vocabulary: list[bytes]):
        self.n = len(folded)
        self.lists: dict[bytes, np.ndarray] = {t: np.zeros(0, np.int64) for t in vocabulary}
        if not vocabulary:
            return
        buf = np.frombuffer(b"\0\0".join(folded) + b"\0\0", np.uint8)
        starts = np.cumsum([0] + [len(f) + 2 for f in folded[:-1]], dtype=np.int64)
        wanted = np.zeros(1 << 24, bool)
        codes = {int.from_bytes(t, "big"): t for t in vocabulary}
        wanted[list(codes)] = True
        for at in range(0, len(buf), 1 << 22):
            part = buf[at:at + (1 << 22) + 2].astype(np.int32)
            code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            hit = np.flatnonzero(wanted[code])
            if not len(hit):
                continue
            doc = np.searchsorted(starts, hit + at, "right") - 1
            pair = np.unique(code[hit].astype(np.int64) * self.n + doc)
            which, first = np.unique(pair // self.n, return_index=True)
            for c, docs in zip(which.tolist(), np.split(pair % self.n, first[1:])):
                t = codes[c]
                self.lists[t] = np.union1d(self.lists[t], docs)

    def candidates(self, q: Query) -> np.ndarray:
        """Texts that meet the query; all of them if it is empty."""
        out = np.arange(self.n)
        for clause in q:
            some = np.zeros(0, np.int64)
            for trigrams in clause:
                docs = out
                for t in sorted(trigrams, key=lambda t: len(self.lists[t])):
                    docs = np.intersect1d(docs, self.lists[t], assume_unique=True)
                some = np.union1d(some, docs)
            out = some
        return out
