r"""Line dedup: lines that many documents share stay in one of them.

A text is split at ``\n``. A line's key is the line stripped of ASCII white
space at both ends, with A-Z lower-cased. Keys of at least ``min_chars`` code
points are exploded as (128-bit hash, document), the distinct documents of
each hash are counted, and a key found in ``min_docs`` documents or more loses
its lines everywhere but in the largest doc_id that holds it. The hashes each
row loses go back to it and the other lines are joined by position.

Scale: only hashes are shuffled for counting (pre-aggregated by (hash,
document) and then by hash, so a line that every document holds is no hot
group); the text moves once, to meet its row's hashes. Rows are written with a
number first and hashes go back by that number, so a group holds no more than
the lines of one row, however many rows have the same doc_id or none.

Defined results: a null or empty text is one empty line. Rows with the same
doc_id are one document for counting, each row is rewritten by itself. A null
doc_id is no document: it isn't counted and never keeps a shared line. An
empty table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import (ASCII_LOWER, ASCII_SPACE, map_batches, materialise, plain_names,
                               replace_text)

MIN_CHARS = 20
MIN_DOCS = 3
_ROW = "__row"


def line_key(line: str) -> str:
    key = line.strip(ASCII_SPACE)
    return key.lower() if key.isascii() else key.translate(ASCII_LOWER)


def key_hash(key: str) -> bytes:
    return hashlib.md5(key.encode(), usedforsecurity=False).digest()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written, with a unique number of each row in ``__row``."""
    return materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered-rows")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS,
                spare: Callable[[str], bool] | None = None) -> DataFrame:
    """(key, doc_id, __row): the distinct long line keys of every numbered row,
    hashed, without those that ``spare`` is true for."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, rows = [], [], []
        for doc_id, text, row in zip(*(c.to_pylist() for c in b.columns)):
            found = {k for k in map(line_key, (text or "").split("\n")) if len(k) >= min_chars}
            if spare:
                found = {k for k in found if not spare(k)}
            keys += map(key_hash, found)
            ids += [doc_id] * len(found)
            rows += [row] * len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())],
            names=["key", "doc_id", _ROW])
    return map_batches(docs.select("doc_id", "text", _ROW), run,
                       f"key binary, doc_id bigint, {_ROW} bigint")


def lost_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                spare: Callable[[str], bool] | None = None) -> DataFrame:
    """(lost_row, lost): the key hashes whose lines each numbered row loses."""
    lines = materialise(line_hashes(docs, min_chars, spare), "line-hashes")
    shared = (lines.groupBy("key")
              .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
              .where(F.col("n") >= min_docs).select("key", "keeper"))
    # written, so that the join below shuffles both sides for itself and adaptive
    # execution can split a line that a large share of all rows holds
    shared = materialise(shared, "shared-lines")
    return (lines.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col(_ROW).alias("lost_row"))
            .agg(F.collect_set("key").alias("lost")))


def drop_lines(text: str | None, lost: set[bytes], min_chars: int) -> tuple[str, int, int]:
    """The text without lost lines, its number of lines before, and of lines lost."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    kept = []
    for line in lines:
        key = line_key(line)
        if len(key) < min_chars or key_hash(key) not in lost:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_lost(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
              spare: Callable[[str], bool] | None = None) -> DataFrame:
    """``docs`` with the column ``__lost`` of hashes its lines lose (null: none)."""
    rows = numbered(docs)
    lost = lost_hashes(rows, min_chars, min_docs, spare)
    return rows.join(lost.withColumnRenamed("lost", "__lost").withColumnRenamed("lost_row", _ROW),
                     _ROW, "left").drop(_ROW)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): one row per row of ``docs``."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [drop_lines(t, set(h or ()), min_chars)
                for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64()),
             pa.array([d[0] for d in done], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept"])
    return map_batches(with_lost(docs.select("doc_id", "text"), min_chars, min_docs), run,
                       "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def rewrite_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      spare: Callable[[str], bool] | None = None) -> DataFrame:
    """``docs``, every column, with the shared lines gone from the texts; lines
    whose key ``spare`` is true for stay everywhere."""
    work = plain_names(docs)
    names = work.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lost = b.column(b.schema.get_field_index("__lost")).to_pylist()
        text = b.column(b.schema.get_field_index("text"))
        changed = {i: drop_lines(text[i].as_py(), set(h), min_chars)[0]
                   for i, h in enumerate(lost) if h}
        return replace_text(b, names, changed)
    return map_batches(with_lost(work, min_chars, min_docs, spare), run, work.schema).toDF(
        *docs.columns)
