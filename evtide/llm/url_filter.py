r"""URL filter over a memory-mapped sorted digest array.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's
host or one of its subdomains and whose path starts with the rule's path; the
longest fitting rule (host and path characters together) wins.

The rules are stored in one file: 64-bit xxhash keys of every rule host in
sorted order, per host the distinct path lengths of its rules, the sorted keys
of the full rules (``host + path``) and the full strings. Spark ships the file
to every executor (``addFile``); tasks memory-map it, so its pages are shared
by all workers of a machine and never held on a heap. A batch of URLs is
probed in two vectorised binary searches: every host suffix against the host
keys, then, for hosts that hit, the suffix with every path prefix of a length
that host has. A key that hits counts only if the stored full string is equal,
and equal keys of different strings are all looked at, so digest collisions
cannot change a verdict.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and gets the default verdict. Repeated rows are judged one
by one. A rule listed twice must have one verdict (else ``ValueError``).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.llm.common import ASCII_LOWER, map_batches
from evtide.shipping import write_bytes
from evtide.session import scratch_path

#: Rules a list may have: the file is built on the driver, about 100 bytes a rule.
MAX_RULES = 20_000_000
_HEAD = struct.Struct("<Q")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if not url:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = len(rest)
    for c in "?#":
        k = rest.find(c, 0, end)
        if k >= 0:
            end = k
    slash = rest.find("/", 0, end)
    if slash < 0:
        slash = end
    return rest[:slash].translate(ASCII_LOWER), rest[slash:end]


def host_suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host]
    k = host.find(".")
    while k >= 0:
        out.append(host[k + 1:])
        k = host.find(".", k + 1)
    return out


def _keys(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode()) for s in strings),
                       np.uint64, len(strings))


def build_index(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """Serialise ``(host, path, verdict)`` rules into the digest file.

    Layout: 8-byte header length, JSON header with the array places, arrays.
    """
    verdict_of: dict[str, str] = {}
    lengths: dict[str, set[int]] = {}
    for host, path, verdict in rules:
        host = host.translate(ASCII_LOWER)
        if verdict_of.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"two verdicts for {host + path}")
        lengths.setdefault(host, set()).add(len(path))
        if len(verdict_of) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
    names = sorted(set(verdict_of.values()))

    def sorted_by_key(strings: list[str]):
        keys = _keys(strings)
        order = np.argsort(keys, kind="stable")
        return keys[order], [strings[i] for i in order]

    def blob(strings: list[str]):
        parts = [s.encode() for s in strings]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return ends, np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    host_keys, hosts = sorted_by_key(list(lengths))
    rule_keys, full = sorted_by_key(list(verdict_of))
    per_host = [sorted(lengths[h]) for h in hosts]
    host_ends, host_text = blob(hosts)
    rule_ends, rule_text = blob(full)
    arrays = {
        "host_keys": host_keys, "host_ends": host_ends, "host_text": host_text,
        "len_ends": np.cumsum([0, *map(len, per_host)], dtype=np.int64),
        "lens": np.array([n for p in per_host for n in p], np.int64),
        "rule_keys": rule_keys, "rule_ends": rule_ends, "rule_text": rule_text,
        "rule_verdict": np.array([names.index(verdict_of[s]) for s in full], np.uint8),
    }
    places, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = a.tobytes() + bytes(-a.nbytes % 8)
        places[name] = [str(a.dtype), at, len(a)]
        at += len(raw)
        body.append(raw)
    head = json.dumps({"arrays": places, "verdicts": names}).encode()
    head += b" " * (-len(head) % 8)
    return _HEAD.pack(len(head)) + head + b"".join(body)


class DigestIndex:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = _HEAD.unpack(f.read(8))[0]
            head = json.loads(f.read(n))
        self.verdicts = head["verdicts"]
        for name, (kind, at, count) in head["arrays"].items():
            a = (np.memmap(path, kind, "r", 8 + n + at, (count,)) if count
                 else np.zeros(0, kind))
            setattr(self, name, a)

    def _string(self, ends, text, i: int) -> str:
        return bytes(text[ends[i]:ends[i + 1]]).decode()

    def _find(self, keys, ends, text, probes: list[str]) -> np.ndarray:
        """Row of every probe, or -1: binary search, then the stored string."""
        want = _keys(probes)
        at = np.searchsorted(keys, want)
        found = np.full(len(probes), -1, np.int64)
        for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want)
                                if len(keys) else []):
            k = int(at[i])
            while k < len(keys) and keys[k] == want[i]:
                if self._string(ends, text, k) == probes[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """Longest fitting rule and its verdict (None, None) per (host, path)."""
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(urls)
        suffixes = sorted({s for host, _ in urls if host for s in host_suffixes(host)})
        rows = dict(zip(suffixes, self._find(self.host_keys, self.host_ends, self.host_text,
                                             suffixes).tolist()))
        probes, owner = [], []
        for i, (host, path) in enumerate(urls):
            if not host:
                continue
            for s in host_suffixes(host):
                h = rows[s]
                if h < 0:
                    continue
                for n in self.lens[self.len_ends[h]:self.len_ends[h + 1]].tolist():
                    if n <= len(path):
                        probes.append(s + path[:n])
                        owner.append(i)
        for i, probe, r in zip(owner, probes, self._find(
                self.rule_keys, self.rule_ends, self.rule_text, probes).tolist()):
            if r >= 0 and (out[i][0] is None or len(probe) > len(out[i][0])):
                out[i] = (probe, self.verdicts[self.rule_verdict[r]])
        return out


def publish_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Build the digest file and give it to every executor; returns its name.

    The file is written to the shared folder, so executors that join later
    fetch it too.
    """
    data = build_index(rules)
    name = f"url-digests-{xxhash.xxh64_hexdigest(data)}.bin"
    if name not in {f.rpartition("/")[2] for f in spark.sparkContext.listFiles}:
        path = f"{scratch_path(spark, 'digests')}/{name}"
        write_bytes(spark, path, data)
        spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]],
                default: str = "allow", id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """Judge every URL: (id, url, host, path, rule, verdict), one row per page."""
    spark = pages.sparkSession
    name = publish_index(spark, rules)
    kept: dict[str, DigestIndex] = {}

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        if name not in kept:
            kept[name] = DigestIndex(SparkFiles.get(name))
        urls = b.column(1).to_pylist()
        parts = {u: split_url(u) for u in set(urls)}
        distinct = sorted(set(parts.values()))
        verdicts = dict(zip(distinct, kept[name].judge(distinct)))
        rows = [parts[u] for u in urls]
        got = [verdicts[r] for r in rows]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.string()),
             pa.array([g[0] for g in got], pa.string()),
             pa.array([g[1] or default for g in got], pa.string())],
            names=[id_col, url_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(
        pages.select(F.col(id_col), F.col(url_col)), judge,
        f"`{id_col}` {kind}, `{url_col}` string, host string, path string, "
        "rule string, verdict string")
