"""Alignment of two tokenizers over a corpus, by lockstep merging.

Every text is encoded by a byte-level tokenizer A (of space + text) and a
sentence-piece tokenizer B (of the text; it adds the space). Where tokens of
both end at one byte, the text is cut and the two tokens are linked.

The documents of a block (a few MB of texts) lie one after another on one byte
axis. They are cut into stretches of equally many A tokens, and one state
vector holds an A and a B pointer for each: a step compares all their token ends
at once, emits links and cuts where they are equal, moves the pointer that is
behind (or both) and drops stretches that are through. So a long document costs
no more steps than a short one.

How often a pair of ids is linked in the corpus is counted by blocks: a block
ships its distinct pairs with their counts, gets the corpus's counts back and
sums them up per document. What is shuffled grows with the distinct pairs of
blocks, not with links, and no table of all pairs goes to a task.

A text that is null, empty or not given back by the bytes of its A or B tokens
(one that holds U+2581, say) has no tokens: zeros and an empty ``groups_sha256``.
Rows may repeat a doc_id or have none; every row is a document.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import WordCache, map_batches, materialise

#: Text bytes of a block, at least one document.
BLOCK_BYTES = 2 << 20
#: A tokens of a stretch.
STRETCH = 512
#: Characters handed to the tokenizers at once.
ENCODE_CHARS = 1 << 20
#: Words a worker keeps in each of two generations, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: A space alone between two characters that are neither white space nor B's
#: mark of a space: no token of A or B reaches over its left edge, so the words
#: between such spaces are encoded one by one, and once.
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")

BLOCK = ("doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
         "digests array<string>, n_pairs array<int>, places array<int>, times array<int>, "
         "pairs array<bigint>, pair_times array<bigint>")
ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "n_best bigint, count_sum bigint, groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable
    Latin-1 stands for itself, the other bytes take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_of = byte_alphabet()
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            if all(c in bytes_of for c in name):
                self.bytes_a[i] = bytes(bytes_of[c] for c in name)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                        else p.replace("▁", " ").encode()
                        for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # an id as text with what follows it: A's in a group and last in it, then B's
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.text = [f"{i}{after}".encode() for i in range(n) for after in (",", "|", ";")]
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.words = WordCache(CACHE_WORDS)

    def _learn(self, new: list[str]) -> None:
        """Put the A ids of space + word and the B ids of the word, and whether
        the bytes of both are just these, in the young generation."""
        known = self.words.young
        for lo, hi in _portions([len(w) for w in new], ENCODE_CHARS):
            part = new[lo:hi]
            coded_a = self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False)
            coded_b = self.b.encode(part, num_threads=1)
            for w, a, b in zip(part, coded_a, coded_b):
                raw, a = (" " + w).encode(), a.ids
                same = (b"".join(map(self.bytes_a.__getitem__, a)) == raw
                        and b"".join(map(self.bytes_b.__getitem__, b)) == raw)
                known[w] = (np.array(a, self.dtype).tobytes(), np.array(b, self.dtype).tobytes(),
                            same)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """(A ids, B ids) of every text in ``dtype``; None where it has no tokens."""
        collecting = gc.isenabled()
        gc.disable()            # no cycles are made here, but millions of objects
        try:
            self.words.turn()
            known = self.words.young
            cut = [pieces(t) for t in texts]
            new = self.words.missing(set().union(*cut) - known.keys())
            self._learn(list(new))
            out: list[tuple[bytes, bytes] | None] = []
            for t, words in zip(texts, cut):
                found = [known[w] for w in words]
                out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))
                           if t and all([f[2] for f in found]) else None)
            for w in new:
                if len(w) > CACHE_CHARS:
                    del known[w]
            return out
        finally:
            if collecting:
                gc.enable()


def _portions(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs of items of about ``limit`` together, at least one item each."""
    out, lo, total = [], 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            out.append((lo, i))
            lo, total = i, 0
        total += s
    return out + ([(lo, len(sizes))] if sizes else [])


def pieces(text: str) -> list[str]:
    """A text cut at plain spaces, without these: A's tokens of space + piece and
    B's of a piece, one piece after another, are those of the whole."""
    return _CUT.split(text)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of all tokens that end together. ``end_a``, ``end_b``:
    token ends on one axis; ``first``: where documents begin in A, and its length."""
    starts = np.concatenate([np.arange(lo, hi, STRETCH) for lo, hi in zip(first, first[1:])]
                            or [np.zeros(0, np.int64)]).astype(np.int64)
    stop = np.minimum.reduce([starts + STRETCH,
                              first[np.searchsorted(first, starts, "right").clip(
                                  0, len(first) - 1)]])
    a = starts.copy()
    b = np.searchsorted(end_b, np.where(a > 0, end_a[np.maximum(a - 1, 0)], 0), "right")
    links_a, links_b = [], []
    while len(a):
        x, y = end_a[a], end_b[b]
        together = x == y
        if together.any():
            links_a.append(a[together])
            links_b.append(b[together])
        a += x <= y
        b += y <= x
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    la, lb = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(la)
    return la[order], lb[order]


def align_block(pair: Pair, texts: list[str]) -> dict:
    """Per document: tokens, groups, digest of the groups, and its distinct
    linked pairs as places in the block's sorted ``pairs``, with their times."""
    coded = pair.encode(texts)
    ids_a, ids_b = (np.frombuffer(b"".join([c[k] for c in coded if c]), pair.dtype)
                    .astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(c[k]) // pair.dtype.itemsize if c else 0 for c in coded], np.int64)
                for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(n_a)])
    la, lb = lockstep(np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b]), first)
    doc = np.searchsorted(first, la, "right") - 1

    # every group's A ids, then its B ids
    before_b = np.concatenate([[0], lb + 1])
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[la], last_b[lb] = True, True
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    codes[at_a + before_b[np.searchsorted(la, at_a)]] = 3 * ids_a + last_a
    codes[at_b + la[np.searchsorted(lb, at_b)] + 1 if len(la) else at_b] = 3 * ids_b + 2 * last_b
    edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    digests = [hashlib.sha256(b"".join(map(pair.text.__getitem__, codes[lo:hi].tolist()))[:-1])
               .hexdigest() if hi > lo else "" for lo, hi in zip(edge, edge[1:])]

    wide = len(pair.bytes_b)
    pairs, place = np.unique(ids_a[la] * wide + ids_b[lb], return_inverse=True)
    each, times = np.unique(doc * max(len(pairs), 1) + place, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=len(texts)),
            "digests": digests,
            "n_pairs": np.bincount(each // max(len(pairs), 1), minlength=len(texts)),
            "places": each % max(len(pairs), 1), "times": times,
            "pairs": pairs // wide << 32 | pairs % wide,
            "pair_times": np.bincount(place, minlength=len(pairs))}


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizers_of(path_a: str, path_b: str) -> Pair:
    """The worker's tokenizers for two vocabulary files."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


_TYPES = {"array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}
_BLOCK = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in BLOCK.split(", ")])


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of documents, its columns lists (see ``align_block``)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pair = tokenizers_of(path_a, path_b)
        texts = [t or "" for t in b.column(1).to_pylist()]
        rows = []
        for lo, hi in _portions([len(t) for t in texts], BLOCK_BYTES):
            r = {"doc_ids": b.column(0)[lo:hi]} | align_block(pair, texts[lo:hi])
            rows.append([pa.ListArray.from_arrays([0, hi - lo if f.name == "doc_ids" else
                                                   len(r[f.name])],
                                                  pa.array(r[f.name], f.type.value_type)
                                                  if f.name != "doc_ids" else
                                                  r[f.name].cast(pa.int64())) for f in _BLOCK])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)],
                                          schema=_BLOCK)
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
                       BLOCK)


def pair_counts(blocked: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus have each pair of ids
    (A's shifted by 32 bits, B's), and whether no other pair of its B id has more."""
    counts = materialise(
        blocked.select(F.inline(F.arrays_zip("pairs", "pair_times")))
        .groupBy("pairs").agg(F.sum("pair_times").alias("count"))
        .select(F.col("pairs").alias("pair"), "count",
                F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count",
                                         (F.col("count") == F.col("most")).alias("best"))


def _documents(b: pa.RecordBatch) -> pa.RecordBatch:
    """The documents of blocks, with the corpus's counts of their pairs."""
    out = []
    for r in range(b.num_rows):
        col = {n: b.column(n)[r].values for n in b.schema.names}
        n = len(col["doc_ids"])
        pairs, places = (col[c].to_numpy() for c in ("pairs", "places"))
        times = col["times"].to_numpy().astype(np.int64)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        if len(pairs):
            known = col["known"]
            at = np.searchsorted(pairs, known.field("pair").to_numpy())
            count[at] = known.field("count").to_numpy()
            best[at] = known.field("best").to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(n), col["n_pairs"].to_numpy())

        def total(values):
            sums = np.zeros(n, np.int64)
            np.add.at(sums, doc, values)
            return sums
        # a group ends with one link: no token is without bytes
        out.append(pa.RecordBatch.from_arrays(
            [col["doc_ids"], col["n_a"], col["n_b"], col["n_groups"], pa.array(total(times)),
             pa.array(total(times * best[places])), pa.array(total(times * count[places])),
             col["digests"]], names=[f.split()[0] for f in ALIGNED.split(", ")]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair is the most frequent of its B id), count_sum (the pairs' counts over all
    links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``)."""
    blocked = materialise(blocks(docs, path_a, path_b).withColumn(
        "block", F.monotonically_increasing_id()), "blocks")
    known = (blocked.select("block", F.explode("pairs").alias("pair"))
             .join(pair_counts(blocked), "pair")
             .groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best"))
                                   .alias("known")))
    return map_batches(blocked.drop("pair_times").join(known, "block", "left").drop("block"),
                       _documents, ALIGNED)
