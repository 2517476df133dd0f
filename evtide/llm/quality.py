"""Quality classifier: supervised subword embeddings with softmax output.

A text's features are its words (split at ASCII white space) and the byte
n-grams of 3 to 5 within words, the white space on either side counting as a
boundary mark; each is hashed to a bucket. A word equal to the one before also
counts as the feature "repeated". A document is the average of its features'
learned vectors (with ``REST`` null vectors, so a few words decide little), a
softmax layer turns it into the probability of
label 1. Vectors and layer are learned by plain stochastic gradient descent in
numpy on a bounded sample of the labelled rows (whole texts in the order of a
hash of their id, up to ``TRAIN_DOCS`` documents or until ``TRAIN_BYTES`` bytes
are used, so long texts are in it in their share), on the driver. Scoring runs where the texts are: averaging the vectors and
applying the layer equals averaging each bucket's share of the score margin,
so a task holds one float a bucket.

Defined results: a null or empty text has no features and is scored by the
layer's bias. Rows are scored one by one. A doc_id labelled more than once
counts as 1 if any of its rows says so; null labels and ids aren't learnt
from. Without a labelled row of both kinds, the score is the share of label 1
(0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evtide.llm.common import map_batches, plain_names

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
#: Bounds of the training sample.
TRAIN_DOCS = 3000
TRAIN_BYTES = 48_000_000
#: Gradient steps, one document each, in passes over the sample.
STEPS = 10_000
RATE = 0.5
SEED = 7
THRESHOLD = 0.3
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Null vectors that every average holds.
REST = 24
#: Bytes hashed at a time. What a word and an n-gram need of the bytes before is
#: carried along, so the features don't depend on it.
_PIECE = 1 << 20
#: Scores are sums of whole multiples of 2**-30, so no order of adding changes them.
_UNIT = 1 << 30


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(32)
    return ((h * _BASE) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_PIECE + 64, int(_BASE))
_DOWN = _powers(_PIECE + 64, pow(int(_BASE), -1, 1 << 64))


def features(raw: bytes) -> np.ndarray:
    """Bucket of every feature of a text's UTF-8 bytes, repeats included."""
    return np.concatenate(list(_parts(raw)))


def counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and how often each occurs, without
    holding all features of a long text at once."""
    n = np.zeros(BUCKETS, np.int64)
    for part in _parts(raw):
        n += np.bincount(part, minlength=BUCKETS)
    f = np.flatnonzero(n)
    return f, n[f]


def _parts(raw: bytes) -> Iterator[np.ndarray]:
    """Features of a text, some for each piece of it, wherever pieces end."""
    state = _Seam()
    for at in range(0, max(len(raw), 1), _PIECE):
        part = raw[at:at + _PIECE]
        part = (b" " if at == 0 else b"") + part + (b" " if at + _PIECE >= len(raw) else b"")
        yield _features(np.frombuffer(part, np.uint8), state)


class _Seam:
    """What goes over from one piece to the next: the open word's hash and
    length, the hash of the word before it, and the last bytes."""

    def __init__(self):
        self.open, self.length = np.uint64(0), 0
        self.before: np.uint64 | None = None
        self.bytes = np.zeros(0, np.uint8)


def _features(b: np.ndarray, state: _Seam) -> np.ndarray:
    space = _SPACE[b]
    b = np.where(space, np.uint8(32), b)
    v = b.astype(np.uint64) + np.uint64(1)
    out = []
    # words: prefix sums of v * base**i, shifted back by the word's start
    edge = np.flatnonzero(space)
    sums = np.cumsum(v * _UP[:len(v)], dtype=np.uint64)
    first, last = (int(edge[0]), int(edge[-1])) if len(edge) else (len(b), -1)
    ahead = np.uint64(pow(int(_BASE), state.length, 1 << 64))
    with np.errstate(over="ignore"):
        opened = state.open + (ahead * sums[first - 1] if first else np.uint64(0))
    length = state.length + first
    starts, ends = edge[:-1] + 1, edge[1:]
    real = ends > starts
    starts, ends = starts[real], ends[real]
    words = (sums[ends - 1] - sums[starts - 1]) * _DOWN[starts]
    if len(edge):
        if length:
            words = np.concatenate([[opened], words])
        tail = len(b) - last - 1
        state.open = ((sums[-1:] - sums[last]) * _DOWN[last + 1])[0] if tail else np.uint64(0)
        state.length = tail
    else:
        state.open, state.length = opened, length
    if len(words):
        out.append(_bucket(words, 1))
        again = np.count_nonzero(words[1:] == words[:-1]) + (state.before == words[0])
        out.append(np.full(again, _REPEATED, np.int64))
        state.before = words[-1]
    # n-grams whose inner bytes hold no white space, those that end in this piece
    held = len(state.bytes)
    b = np.concatenate([state.bytes, b])
    v = b.astype(np.uint64) + np.uint64(1)
    inner = np.concatenate([[0], np.cumsum(b == 32)])
    for n in GRAMS:
        at = max(held - n + 1, 0)
        m = len(b) - n + 1 - at
        if m <= 0:
            continue
        h = v[at:at + m].copy()
        for k in range(1, n):
            h = h * _BASE + v[at + k:at + k + m]
        whole = inner[at + n - 1:at + n - 1 + m] == inner[at + 1:at + 1 + m]
        out.append(_bucket(h, n)[whole])
    state.bytes = b[max(len(b) - max(GRAMS) + 1, 0):]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_REPEATED = int(_bucket(np.zeros(1, np.uint64), 2)[0])


class Model:
    """margin: each bucket's part of the log odds of label 1; bias: the rest."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias
        self.units = np.rint(margin.astype(np.float64) * _UNIT).astype(np.int64)

    def score(self, text: str | None) -> float:
        total, n = 0, 0
        for f in _parts((text or "").encode()):
            total += int(self.units[f].sum())
            n += len(f)
        z = self.bias + total / _UNIT / (n + REST)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[str], labels: list[int], steps: int = STEPS,
          rate: float = RATE) -> Model:
    """Stochastic gradient descent over documents in a fixed random order."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer = np.zeros((2, WIDTH), np.float32)
    bias = np.zeros(2, np.float32)
    seen = []
    for t in texts:
        f, n = counted(t.encode())
        seen.append((f.astype(np.int32), (n / (REST + n.sum())).astype(np.float32)))
    done = 0
    while done < steps:
        for i in rng.permutation(len(y))[:steps - done]:
            f, share = seen[i]
            lr = np.float32(rate * (1 - done / steps))
            rows = vectors[f]
            hidden = share @ rows
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            grad = p / p.sum()
            grad[y[i]] -= 1
            back = grad @ layer
            layer -= lr * np.outer(grad, hidden)
            bias -= lr * grad
            # the average's gradient, scaled to the vectors' share of it
            vectors[f] = rows - (lr * _VECTOR_GAIN) * share[:, None] * back
            done += 1
    diff = layer[1] - layer[0]
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]))


#: Vectors are averaged over thousands of features; their steps are longer for it.
_VECTOR_GAIN = np.float32(20.0)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS,
                  budget: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold, at most ``limit``; the last is
    the one that uses up the ``budget`` of bytes.

    Labels meet the ids and lengths of the texts first, and the sample is taken
    from what there is, by a hash of the id; only its texts are collected.
    """
    kinds = (labels.select("doc_id", "quality")
             .where("doc_id is not null and quality is not null")
             .where(remainder() != 0)
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    sized = docs.select("doc_id", "text", F.octet_length("text").alias("bytes")).where(
        "text is not null")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("bytes"))
    found = (sized.drop("text").join(kinds, "doc_id").orderBy(*order).limit(limit)
             .select("doc_id", "bytes", "quality"))
    some, total = [], 0
    for r in found.collect():
        if total >= budget:
            break
        some.append(r)
        total += r.bytes
    chosen = docs.sparkSession.createDataFrame(list(dict.fromkeys(some)), found.schema)
    # rows alike in id and length are as many as were chosen, so the bounds hold
    rows = (sized.join(F.broadcast(chosen), ["doc_id", "bytes"])
            .orderBy(*order, "text").limit(len(some))
            .select("text", "quality").toArrow())
    return rows.column(0).to_pylist(), [int(q) for q in rows.column(1).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_rows(docs, labels))


def with_score(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with the score in the new double ``column``."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(*shared.value)
        scores = [m.score(t) for t in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())],
                                          names=[*b.schema.names, column])
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select(
        "doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, every column, without the rows the classifier rejects."""
    scored = with_score(plain_names(docs), fit(docs, labels), "score")
    return scored.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
