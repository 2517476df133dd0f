"""Secret scan over a trigram inverted index.

Texts are indexed shard by shard (a shard is a slice of a task's batch): for
the trigrams that the rules need, the sorted list of texts holding each. A
rule's Boolean trigram query, derived from its regular expression, is answered
by intersecting and uniting postings, and only the texts left are searched
with the expression itself. A rule whose expression guarantees no trigram (the
hex rule) searches every text. The index narrows where to look and nothing
else: results equal a full scan. Shards never leave their task, so nothing is
shuffled and a lost executor costs its tasks only.

Defined results: a null or empty text has no spans. Rows are scanned whole and
one by one, so repeated ids are no matter; an empty table gives no rows.
Spans are in code points, the end exclusive, of the whole match. A private key
is its BEGIN banner and all up to the END banner; without an END, the base64
lines that follow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from evtide.llm.common import map_batches, replace_text
from evtide.llm.trigrams import Postings, Query, query

#: Bytes of text in a shard of the index.
SHARD_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three kinds of the contract.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 or more are the long ones among the leftmost [0-9a-f]+
    Rule("hex", r"[0-9a-f]{16,}"),
)
_KEY = r"(?:[A-Z0-9]+\x20){0,3}PRIVATE\x20KEY(?:\x20BLOCK)?\x20?-{4,5}"
# what stands between base64 lines: line ends, also escaped ones, quotes, comment signs
_GAP = r"""(?:[\s>#*"',;|]|\\[nrt]?|\+(?=\s))++"""
_PRIVATE_KEY = (
    r"-{4,5}\x20?BEGIN\x20" + _KEY + "(?:"
    # anything without banners, then END
    r"[^-]*+(?:-(?!---[-\x20])[^-]*+)*+-{4,5}\x20?END\x20" + _KEY
    # no END: header lines, full base64 lines, a last short one, a checksum
    + r"|(?:(?:\r?\n|\\n)[\x20\t>#*|]*[A-Za-z][A-Za-z0-9-]*:(?:[^\r\n\\]|\\(?![nr]))*+){0,20}"
    r"(?:" + _GAP + r"[A-Za-z0-9+/]{16,}+)+"
    r"(?:={1,2}|" + _GAP + r"""[A-Za-z0-9+/]{1,15}={0,2}(?![^\s\\"',;]))?"""
    r"(?:" + _GAP + r"""=[A-Za-z0-9+/]{4}(?![^\s\\"',;]))?"""
    ")?")
_BANNER = re.compile(r"-{4,5}\x20?(BEGIN|END)\x20" + _KEY, re.ASCII | re.IGNORECASE)
# Public formats of well-known credentials.
EXTRA_RULES = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + EXTRA_RULES

Span = tuple[str, int, int]


def opens_or_ends_key(line: str) -> bool:
    """Whether a private key begins in the line and ends in another, or the
    other way round: without such a line the rest of the key can't be told."""
    if "----" not in line or "private key" not in line.lower():
        return False
    banners = [m[1].lower() for m in _BANNER.finditer(line)]
    return banners.count("begin") != banners.count("end")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), query(r.pattern)) for r in rules]
        self.vocabulary = sorted({t for _, _, q in self.rules for c in q for s in c for t in s})

    def scan(self, texts: list[str]) -> list[list[Span]]:
        """Spans of every text, by start, then in the order of the rules."""
        index = Postings([t.encode().lower() for t in texts], self.vocabulary)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, q) in enumerate(self.rules):
            for i in index.candidates(q).tolist():
                for m in regex.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(s)] for s in out]


def shards(texts: list[str], size: int = SHARD_BYTES):
    """Consecutive slices of about ``size`` characters."""
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield texts[at:i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def scan_batch(scanner: Scanner, texts: list[str | None]) -> list[list[Span]]:
    return [s for part in shards([t or "" for t in texts]) for s in scanner.scan(part)]


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans are structs (kind, start, end) in text order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made: list[Scanner] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(rules))
        found = scan_batch(made[0], b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f]
                                    for f in found], kind)], names=["doc_id", "spans"])
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[Span], mark: str = "<SECRET>") -> str:
    """The text with every stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, every column, with the secrets in the texts replaced."""
    names, made = docs.columns, []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(rules))
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        changed = {i: redact(texts[i], s) for i, s in enumerate(scan_batch(made[0], texts)) if s}
        return replace_text(b, names, changed)
    return map_batches(docs, run, docs.schema)
