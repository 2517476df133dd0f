"""Row numbers and running sums inside groups of any size, by one range exchange.

A window partitioned by group puts a hot group into one task. Here rows are
range-partitioned on (group, order), so a big group is cut into many
partitions, sorted there and checkpointed: later passes see the very same
partitions, also after an executor loss. A sorted partition holds whole groups
but for its first and last run, so one summary row per partition (first and
last group, their counts and sums) tells what its first group brings along from
earlier partitions. A second pass over the same partitions numbers the rows;
nothing is shuffled again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtide.session import checkpoint_dir
from evtide.shipping import ship_package


def _key(columns: list[pa.Array], i: int) -> tuple:
    """The group of row ``i``; floats as Spark groups them (one NaN, one zero)."""
    return tuple("NaN" if v != v else v + 0.0 if isinstance(v, float) else v
                 for v in (c[i].as_py() for c in columns))


def _starts(columns: list[pa.Array], before: tuple | None, n: int) -> np.ndarray:
    """Rows of a batch that begin another group than the row before them."""
    new = np.zeros(n, bool)
    for c in columns:
        a, b = c[1:], c[:-1]
        differs = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(c.type):
            differs = pc.and_(differs, pc.invert(pc.fill_null(
                pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        differs = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    new[0] = before is None or _key(columns, 0) != before
    return new


def _columns(b: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [b.column(b.schema.get_field_index(c)) for c in names]


def _longs(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """(names, rows) int64, nulls as zero."""
    return np.array([pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                     for c in _columns(b, names)], np.int64).reshape(len(names), b.num_rows)


def _summarise(batches: Iterator[pa.RecordBatch], group: list[str],
               added: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for the partition: its first and last group, and how many rows
    and which sums each has here."""
    first = last = None
    runs, n, sums = 0, 0, np.zeros(len(added), np.int64)
    head = (0, sums)
    for b in batches:
        if not b.num_rows:
            continue
        cols, values = _columns(b, group), _longs(b, added)
        starts = np.flatnonzero(_starts(cols, last, b.num_rows))
        if first is None:
            first = _key(cols, 0)
        if len(starts):
            if runs == 1:
                head = (n + int(starts[0]), sums + values[:, :starts[0]].sum(1))
            elif runs == 0 and len(starts) > 1:
                head = (int(starts[1]), values[:, :starts[1]].sum(1))
            runs += len(starts)
            n, sums = b.num_rows - int(starts[-1]), values[:, starts[-1]:].sum(1)
        else:
            n, sums = n + b.num_rows, sums + values.sum(1)
        last = _key(cols, b.num_rows - 1)
    if first is not None:
        if runs == 1:
            head = (n, sums)
        note = pickle.dumps((first, last, runs == 1, head, (n, sums)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([note])],
            names=["pid", "note"])


def _carried(notes: list[tuple], backward: bool) -> dict[int, tuple]:
    """What the first (``backward``: last) group of a partition brings along
    from the partitions before (after) it: (group, rows, sums)."""
    out: dict[int, tuple] = {}
    at = None
    for pid, (first, last, single, head, tail) in reversed(notes) if backward else notes:
        near, far = (last, first) if backward else (first, last)
        n, sums = head if backward else tail
        if at and at[0] == near:
            out[pid] = at
            if single:
                n, sums = n + at[1], sums + at[2]
        at = (far, n, sums)
    return out


def _number(batches: Iterator[pa.RecordBatch], group: list[str], added: list[str],
            carried: dict[int, tuple], position: str | None,
            names: list[str], inclusive: int) -> Iterator[pa.RecordBatch]:
    """The rows with their index in the group and running sums, the first
    ``inclusive`` of them up to the row itself, the others up to the row before."""
    last, n, sums = carried.get(TaskContext.get().partitionId(),
                                (None, 0, np.zeros(len(added), np.int64)))
    for b in batches:
        size = b.num_rows
        if not size:
            continue
        cols, values = _columns(b, group), _longs(b, added)
        new = _starts(cols, last, size)
        row = np.arange(size)
        begin = np.maximum.accumulate(np.where(new, row, -1))
        at = np.where(begin < 0, n + row, row - begin)
        total = values.cumsum(1)
        less = np.where(begin > 0, total[:, np.maximum(begin - 1, 0)], 0)
        run = np.where(begin < 0, total + sums[:, None], total - less)
        out = [pa.array(at)] if position else []
        out += [pa.array(r if i < inclusive else r - values[i]) for i, r in enumerate(run)]
        yield pa.RecordBatch.from_arrays(b.columns + out, names=b.schema.names + (
            [position] if position else []) + names)
        last, n, sums = _key(cols, size - 1), int(at[-1]) + 1, run[:, -1]


def running(df: DataFrame, group: list[str], order: list[Column], position: str | None = None,
            sums: dict[str, str] | None = None, size: str | None = None,
            num_partitions: int | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``position`` (0-based index of a row in its group by ``order``),
    ``sums`` (new column -> long column summed from the group's first row to this
    one, wrapping at 64 bits, a null as 0), ``before`` (the same up to the row
    before) and ``size`` (rows of the group).

    A null group is a group. Rows that are equal in ``order`` come in any order,
    fixed by the checkpoint, and in one partition: give the order a last key
    that tells rows apart. The driver sees one row per partition.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    sums, before = sums or {}, before or {}
    names, added = [*sums, *before], [*sums.values(), *before.values()]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(g).asc() for g in group] + list(order)
    if not by:
        raise ValueError("neither a group nor an order")
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).checkpoint(eager=True)
    # no group: every row needs a column to travel by
    slim = ranged.select(*dict.fromkeys(group + added)) if group or added else \
        ranged.select(F.lit(0).alias("_"))
    notes = sorted((r.pid, pickle.loads(r.note)) for r in slim.mapInArrow(
        lambda it: _summarise(it, group, added), "pid int, note binary").collect())
    out = _pass(ranged, group, added, _carried(notes, False), position, names, len(sums))
    if size:
        # the index from the end, over the same partitions sorted the other way
        back = [F.col(g).desc_nulls_last() for g in group]
        place = position or "_at"
        if not position:
            out = _pass(ranged, group, added, _carried(notes, False), place, names, len(sums))
        flipped = out.sortWithinPartitions(*back, F.col(place).desc())
        out = _pass(flipped, group, [], {p: (k, m, np.zeros(0, np.int64)) for p, (k, m, _) in
                                         _carried(notes, True).items()}, "_left", [], 0)
        out = out.withColumn(size, F.col(place) + F.col("_left") + 1).drop("_left")
        out = out if position else out.drop(place)
    return out


def _pass(df: DataFrame, group: list[str], added: list[str], carried: dict[int, tuple],
          position: str | None, names: list[str], inclusive: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(carried)
    fields = list(df.schema.fields)
    fields += [T.StructField(c, T.LongType(), False)
               for c in ([position] if position else []) + names]
    return df.mapInArrow(lambda it: _number(it, group, added, held.value, position, names,
                                            inclusive), T.StructType(fields))
