"""Packing documents into fixed-length sequences along a space-filling curve.

Every document is tokenised whole. Its token ids are hashed into a sparse
vector of log counts, the unit vector is projected to four dimensions by a
fixed random matrix, and the point's place on a Hilbert curve becomes the sort
key, so documents with similar words are neighbours. The tokenised table is
written once to the shared folder, range-partitioned by (key, document, row)
-- the row number splits a run of equal documents over tasks -- and sorted;
each task then cuts its stretch of the curve, laid end to end, into sequences.

No token is padding: a task's last, incomplete sequence is cut into sequences
whose lengths are powers of two.

Defined results: a null text is empty; an empty document is the single end id;
null ids and repeated rows are packed like any other row; an empty table gives
no rows. A text of any length is cut over as many sequences as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import map_batches, materialise
from evtide.llm.word_tokens import encoder

DIMENSIONS = 4
BITS = 15
#: Buckets that token ids are hashed into, and the seed of the projection.
BUCKETS = 2048
SEED = 20240205
_SEQ_SHIFT = 40


def projection() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def hashed_point(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The document's hashed log-count vector, normalised and projected."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
    counts = np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    v = np.log1p(counts[held]).astype(np.float32)
    norm = float(np.sqrt(v @ v))
    return (v / norm) @ matrix[held] if norm else np.zeros(DIMENSIONS, np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS, reach: float = 4.0) -> np.ndarray:
    """Place of each point on the Hilbert curve of a grid with ``bits`` bits a side.

    ``points`` (n, d) are clipped to [-reach, reach]. The axes are turned into
    the curve's transposed index by undoing reflections and exchanges from the
    highest bit down, then Gray decoding, all points at once.
    """
    n, d = points.shape
    top = (1 << bits) - 1
    x = np.clip((points + reach) / (2 * reach) * top, 0, top).astype(np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def tokenise(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids, curve): whole-text ids with ``end_id`` and the Hilbert key."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary)
        matrix = projection()
        end = np.array([end_id], enc.dtype).tobytes()
        raw = []
        texts = b.column(1).to_pylist()
        for i in range(0, len(texts), 500):
            raw += enc.encode([t or "" for t in texts[i:i + 500]])
        points = np.array([hashed_point(np.frombuffer(r, enc.dtype), matrix) for r in raw],
                          np.float32)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([r + end for r in raw], pa.binary()),
             pa.array(hilbert_keys(points))], names=["doc_id", "ids", "curve"])
    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, ids binary, curve bigint")


def _powers(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Lays documents end to end and emits the pieces of full sequences."""

    def __init__(self, length: int, first_sequence: int, dtype: np.dtype):
        self.length, self.sequence, self.dtype = length, first_sequence, dtype
        self.open: list[tuple] = []     # (doc, start, ids, tokens of the document)
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.length - self.filled)
            self.open.append((doc_id, at, ids[at:at + take], n))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), n, self.sequence,
                              offset, raw))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Cut what is left into sequences of power-of-two lengths."""
        left, pending = _powers(self.filled), self.open
        for size in left:
            pieces, room = [], size
            while room:
                doc_id, start, ids, n = pending[0]
                take = min(room, len(ids))
                pieces.append((doc_id, start, ids[:take], n))
                pending = ([(doc_id, start + take, ids[take:], n)] if take < len(ids) else []) \
                    + pending[1:]
                room -= take
            self._close(pieces)
        self.open, self.filled = [], 0

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECE_DDL = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
              "doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ``ids`` are little-endian unsigned 32-bit. ``sequence_id`` holds the task's
    place on the curve above bit 40 and counts its sequences below. ``length``
    must be a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    tokens = materialise(
        tokenise(docs, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()),
        "tokens")
    ordered = (tokens.repartitionByRange("curve", "doc_id", "row")
               .sortWithinPartitions("curve", "doc_id", "row").select("doc_id", "ids"))

    dtype = encoder(vocabulary).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << _SEQ_SHIFT, dtype)

        def out():
            rows = packer.take_rows()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype))
                if len(packer.rows) >= 2000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()
    return ordered.mapInArrow(run, _PIECE_DDL)
