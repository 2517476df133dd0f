"""Tables stored in sorted ranges with a position index.

A table is cut by range partitioning into many ranges of a sort order, each a
partition folder of its own, and an index beside it says how many rows each range
has, for every group where the order is within groups, and how many come before it:
prefix sums over a table of one row per (range, group). So a position is found by
reading the index and the one or two ranges that hold it, not the table.

Changes rewrite the ranges they fall in (``sources.sinks.replace_partitions``: beside
the table first, then swapped) and make a new version of the index; prefix sums are
taken over the index alone. Ranges grow with what is added to them; ``write`` the table
anew when they have become uneven.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evtide.operators.running import running
from evtide.session import path_exists
from evtide.sources import sinks

RANGE = "range"


def write(df: DataFrame, base: str, order: list[str], group: str | None = None,
          ranges: int | None = None) -> None:
    """Store ``df`` sorted by (group, order) in ``ranges`` ranges, with its index.
    The order's columns tell rows apart within a group."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([group] if group else []), *order]
    cut = (df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id())
           .sortWithinPartitions(RANGE, *keys))
    cut.write.partitionBy(RANGE).parquet(f"{base}/data")
    sinks.write_note(df.sparkSession, f"{base}/_layout",
                     {"schema": cut.schema.json(), "order": order, "group": group})
    reindex(df.sparkSession, base)


def layout(spark: SparkSession, base: str) -> tuple[StructType, list[str], str | None]:
    """(schema with the range, order, group) of the stored table."""
    note = json.loads(sinks.read_note(spark, f"{base}/_layout"))
    return StructType.fromJson(json.loads(note["schema"])), note["order"], note["group"]


def data(spark: SparkSession, base: str, only: list[int] | None = None) -> DataFrame:
    """The stored rows with their range; of some ranges ``only``, without as much
    as listing the others."""
    schema = layout(spark, base)[0]
    if only is None:
        return spark.read.schema(schema).parquet(f"{base}/data")
    paths = [p for p in (f"{base}/data/{RANGE}={r}" for r in only) if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/data").parquet(*paths)


def reindex(spark: SparkSession, base: str) -> None:
    """Count all ranges anew: after writing, and after a change that broke off
    between its rows and the index."""
    sinks.finish_rewrite(spark, f"{base}/data")
    _, order, group = layout(spark, base)
    _write_index(_counted(data(spark, base), order, group), base)


def _counted(rows: DataFrame, order: list[str], group: str | None) -> DataFrame:
    """(range, board, n, first): a row per range and group, ``board`` null without one."""
    board = F.col(group) if group else F.lit(None).cast("string")
    return rows.groupBy(RANGE, board.alias("board")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def _write_index(counted: DataFrame, base: str) -> None:
    # a row per range and group: the windows run over the index, not the rows
    per = Window.partitionBy("board")
    before = per.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sinks.write_version(counted.select(
        RANGE, "board", "n", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(per).alias("total")), f"{base}/index")


def index(spark: SparkSession, base: str) -> DataFrame:
    """(range, board, n, first, before, total) of the current version."""
    return sinks.read_current(spark, f"{base}/index")


# ---------------------------------------------------------------- by position
def page(spark: SparkSession, base: str, limit: int, offset: int = 0,
         descending: bool = False) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` of a table stored without groups, in order.

    The index picks the ranges; the rows of these are sorted, no others are read.
    """
    found = index(spark, base).select(RANGE, "n", "before", "total")
    size = found.agg(F.max("total")).first()[0] or 0
    lo, hi = ((max(size - offset - limit, 0), max(size - offset, 0)) if descending
              else (min(offset, size), min(offset + limit, size)))
    # the ranges that a page overlaps: as many as it is long, at most
    hit = found.where((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).collect()
    rows = data(spark, base, [r[RANGE] for r in hit]).drop(RANGE)
    first = min((r.before for r in hit), default=0)
    last = max((r.before + r.n for r in hit), default=0)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in layout(spark, base)[1]]
    skip = last - hi if descending else lo - first
    return rows.orderBy(*keys).limit(skip + hi - lo).offset(skip)


def fences(spark: SparkSession, base: str) -> list[Row]:
    """(range, n, before, first) of every range of a table stored without groups, in
    order: what tells where a page lies. A row per range, as many as the bounds that
    Spark itself holds when it cuts a table by range."""
    return index(spark, base).select(RANGE, "n", "before", "first").orderBy(RANGE).collect()


def after(spark: SparkSession, base: str, key: tuple | None, count: int,
          known: list[Row] | None = None) -> DataFrame:
    """The first ``count`` rows behind ``key`` (a value per order column; None: from
    the start) of a table stored without groups, in order. The index (or its ``known``
    fences) tells where they begin and how many ranges they take; no others are read."""
    known = _behind(fences(spark, base) if known is None else known, key)
    # the first range may hold few rows behind the key, the others hold them all
    hit = [r[RANGE] for r in known if r.before < known[0].before + known[0].n + count]
    return _rows_behind(spark, base, key, hit).orderBy(*layout(spark, base)[1]).limit(count)


def ends(spark: SparkSession, base: str, key: tuple | None, count: int, pages: int = 1,
         known: list[Row] | None = None) -> list[tuple[list, int]]:
    """(key of the last row, number of rows) of the next ``pages`` pages of ``count``
    rows behind ``key``; fewer, and a shorter last one, where the table ends."""
    order = layout(spark, base)[1]
    w = Window.orderBy(*order)                  # over the keys of these pages
    keys = after(spark, base, key, count * pages, known).select(
        *order, F.row_number().over(w).alias("_k"), F.lead(F.lit(1)).over(w).alias("_more"))
    found = keys.where((F.col("_k") % count == 0) | F.col("_more").isNull()).orderBy("_k").collect()
    return [([r[c] for c in order], (r._k - 1) % count + 1) for r in found]


def between(spark: SparkSession, base: str, key: tuple | None, last: tuple,
            known: list[Row] | None = None) -> DataFrame:
    """The rows behind ``key`` (None: from the start) as far as ``last``, its own row
    too, in order: a page whose ends are known. The index (or its ``known`` fences) tells
    the ranges; one task sorts the page."""
    schema, order, _ = layout(spark, base)
    known = _behind(fences(spark, base) if known is None else known, key)
    hit = [r[RANGE] for r in known if _sortable(r["first"]) <= _sortable(last)]
    rows = _rows_behind(spark, base, key, hit).where(
        F.struct(*order) <= _literal(schema, order, last))
    first = F.col(order[0])     # the files' statistics know single columns
    rows = rows.where(first.isNull() if last[0] is None else first.isNull() | (
        first <= F.lit(last[0]).cast(schema[order[0]].dataType)))
    return rows.coalesce(1).sortWithinPartitions(*order)


def _sortable(key: tuple) -> tuple:
    """A key that Python compares as Spark sorts it: nulls first."""
    return tuple((v is not None, v) for v in key)


def _literal(schema: StructType, order: list[str], key: tuple):
    return F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(order, key)])


def _behind(known: list[Row], key: tuple | None) -> list[Row]:
    """The fences without those of the ranges that end before ``key``."""
    if key is None:
        return known
    return known[max(bisect_right(known, _sortable(key), key=lambda r: _sortable(r["first"])) - 1,
                     0):]


def _rows_behind(spark: SparkSession, base: str, key: tuple | None, hit: list[int]) -> DataFrame:
    """The rows of the ranges ``hit`` that are behind ``key``, in no order."""
    schema, order, _ = layout(spark, base)
    rows = data(spark, base, hit).drop(RANGE)
    if key is None:
        return rows
    if key[0] is not None:      # the files' statistics know single columns
        rows = rows.where(F.col(order[0]) >= F.lit(key[0]).cast(schema[order[0]].dataType))
    return rows.where(F.struct(*order) > _literal(schema, order, key))


# ---------------------------------------------------------------- changes
def trim(spark: SparkSession, base: str, keep: int) -> int:
    """Keep the last ``keep`` rows of a table stored without groups: ranges before
    the cut go unread, the one at the cut is rewritten, later ones stay as they are.
    Returns how many rows went."""
    sinks.finish_rewrite(spark, f"{base}/data")
    _, order, group = layout(spark, base)
    idx = index(spark, base)
    cut = max((idx.agg(F.max("total")).first()[0] or 0) - max(keep, 0), 0)
    if not cut:
        return 0
    gone = [r[0] for r in idx.where(F.col("before") < cut).select(RANGE).collect()]
    edge = idx.where((F.col("before") < cut) & (F.col("before") + F.col("n") > cut)).first()
    rows = data(spark, base, [edge[RANGE]] if edge else [])
    if edge:        # the rows of one range
        place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
        rows = rows.withColumn("_k", place).where(F.col("_k") > cut - edge.before).drop("_k") \
            .sortWithinPartitions(RANGE, *order)
    sinks.replace_partitions(rows, f"{base}/data", RANGE, gone)
    kept = idx.where(~F.col(RANGE).isin(gone)).select(RANGE, "board", "n", "first")
    _write_index(kept.unionByName(_counted(data(spark, base, gone), order, group)), base)
    return cut


def locate(spark: SparkSession, base: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the range they belong to: that of the last range whose first
    row is not after them (the first range for rows before all).

    Rows and fences (range and first key) are sorted together; the running
    sum of the steps from one range number to the next is the range.
    """
    _, order, group = layout(spark, base)
    fences = index(spark, base)
    keys = [*([group] if group else []), *order]
    w = Window.orderBy(RANGE)                   # over a row per range
    low = fences.groupBy(RANGE).agg(F.min(F.struct(
        *([F.col("board").alias(group)] if group else []),
        *[F.col(f"first.{c}").alias(c) for c in order])).alias("f"))
    steps = low.select(*[F.col(f"f.{c}").alias(c) for c in keys], (
        F.col(RANGE) - F.coalesce(F.lag(RANGE).over(w), F.lit(0))).cast("bigint").alias("_step"),
        F.lit(0).alias("_row"))
    both = rows.withColumn("_step", F.lit(0).cast("bigint")).withColumn("_row", F.lit(1)) \
        .unionByName(steps, allowMissingColumns=True)
    out = running(both, [], [F.col(c).asc() for c in keys] + [F.col("_row").asc()],
                  sums={RANGE: "_step"}).where("_row = 1")
    least = fences.agg(F.min(RANGE)).first()[0] or 0
    return out.drop("_step", "_row").withColumn(
        RANGE, F.greatest(F.col(RANGE), F.lit(least)).cast("int"))


def merge(spark: SparkSession, base: str, gone: DataFrame, new: DataFrame) -> list[int]:
    """Take rows out (``gone``: range and keys) and put rows in (``new``: all
    columns, with their range); returns the ranges that were rewritten."""
    _, order, group = layout(spark, base)
    keys = [*([group] if group else []), *order]
    gone, new = gone.select(RANGE, *keys), new.select(*data(spark, base).columns)
    touched = sorted(r[0] for r in gone.select(RANGE).union(new.select(RANGE)).distinct().collect())
    if not touched:
        return []
    there = data(spark, base, touched)
    same = there[RANGE].eqNullSafe(F.col("_range"))
    for k in keys:
        same = same & there[k].eqNullSafe(F.col(f"_{k}"))
    rest = there.join(gone.select(*[F.col(c).alias(f"_{c}") for c in gone.columns]),
                      same, "left_anti")
    rows = rest.unionByName(new).sortWithinPartitions(RANGE, *keys)
    sinks.replace_partitions(rows, f"{base}/data", RANGE, touched)
    kept = index(spark, base).where(~F.col(RANGE).isin(touched)).select(
        RANGE, "board", "n", "first")
    _write_index(kept.unionByName(_counted(data(spark, base, touched), order, group)), base)
    return touched
