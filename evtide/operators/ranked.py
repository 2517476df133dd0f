"""Boards with stored order statistics: the ranks of given members.

A board table is kept twice: in ranges of (board, score, member) with the position
index of ``sources.ranges`` -- how many members of a board lie in a range and before it
-- and by a hash of the member, to find a member's score. The rank of listed members
then needs the buckets that hold them, the ranges that hold their scores and the index.
No board is sorted, and what is read grows with the list, not with the boards. Score
increments move members between ranges and rewrite only the ranges and buckets they
touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evtide.sources import ranges, sinks

ORDER = ["score", "member"]
BUCKET = "bucket"
BUCKETS = 32
_ROWS = ("board", "member", "score")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64("member"), F.lit(buckets)).cast("int"))


def write(board: DataFrame, base: str, num_ranges: int | None = None) -> None:
    """Store boards (board, member, score) in both layouts under ``base``."""
    spark = board.sparkSession
    ranges.write(board.select(*_ROWS), base, ORDER, "board", num_ranges)
    placed = _bucketed(ranges.data(spark, base), BUCKETS)
    (placed.repartition(BUCKET).sortWithinPartitions(BUCKET, "board", "member")
     .write.partitionBy(BUCKET).parquet(f"{base}/members"))


def _stored_members(spark: SparkSession, base: str, buckets: list[int]) -> DataFrame:
    schema = ranges.layout(spark, base)[0]
    return spark.read.schema(schema.add(BUCKET, IntegerType())).parquet(f"{base}/members").where(
        F.col(BUCKET).isin(buckets))


def _members(spark: SparkSession, base: str, wanted: DataFrame) -> DataFrame:
    """Stored (board, member, score, range) of the wanted boards and members.
    Only their buckets are read: a value per bucket goes to the driver."""
    keys = _bucketed(wanted.select("board", "member").distinct(), BUCKETS)
    held = [r[0] for r in keys.select(BUCKET).distinct().collect()]
    there = _stored_members(spark, base, held)
    w = keys.select(F.col("board").alias("_b"), F.col("member").alias("_m"))
    return there.join(w, F.col("board").eqNullSafe(F.col("_b"))
                      & F.col("member").eqNullSafe(F.col("_m")), "left_semi").drop(BUCKET)


def ranks_of(spark: SparkSession, base: str, wanted: DataFrame) -> DataFrame:
    """(board, member, score, rank, reverse_rank) of the listed (board, member)
    that are on their boards; equal to those rows of ``keyed.with_ranks``."""
    found = _members(spark, base, wanted)
    hit = [r[0] for r in found.select(ranges.RANGE).distinct().collect()]
    # runs of one board in one range: no more rows than a range has
    run = Window.partitionBy(ranges.RANGE, "board").orderBy(*ORDER)
    boards = found.select(F.col(ranges.RANGE).alias("_r"), F.col("board").alias("_b")).distinct()
    rows = ranges.data(spark, base, hit)
    rows = rows.join(boards, (F.col(ranges.RANGE) == F.col("_r"))
                     & F.col("board").eqNullSafe(F.col("_b")), "left_semi")
    placed = rows.withColumn("_at", F.row_number().over(run) - 1)
    m = found.select(F.col("board").alias("_b"), F.col("member").alias("_m"))
    placed = placed.join(m, F.col("board").eqNullSafe(F.col("_b"))
                         & F.col("member").eqNullSafe(F.col("_m")), "left_semi")
    idx = ranges.index(spark, base).where(F.col(ranges.RANGE).isin(hit)).select(
        F.col(ranges.RANGE).alias("_r"), F.col("board").alias("_b"), "before", "total")
    at = placed.join(idx, (F.col(ranges.RANGE) == F.col("_r"))
                     & F.col("board").eqNullSafe(F.col("_b")))
    rank = (F.col("before") + F.col("_at")).cast("bigint")
    return at.select(*_ROWS, rank.alias("rank"),
                     (F.col("total") - 1 - rank).cast("bigint").alias("reverse_rank"))


def add_scores(spark: SparkSession, base: str, increments: DataFrame) -> list[int]:
    """Add ``delta`` to each (board, member) of a stored board (A26, increments on an
    existing board); members new to a board start from 0. Returns the ranges
    that were rewritten."""
    inc = increments.groupBy("board", "member").agg(F.sum("delta").cast("double").alias("_inc"))
    inc = inc.where(F.col("_inc").isNotNull()).checkpoint(eager=True)
    old = _members(spark, base, inc).checkpoint(eager=True)
    o = old.select(F.col("board").alias("_b"), F.col("member").alias("_m"),
                   F.col("score").alias("_old"))
    after = inc.join(o, F.col("board").eqNullSafe(F.col("_b"))
                     & F.col("member").eqNullSafe(F.col("_m")), "left").select(
        "board", "member", (F.coalesce("_old", F.lit(0.0)) + F.col("_inc")).alias("score"))
    placed = ranges.locate(spark, base, after).checkpoint(eager=True)
    touched = ranges.merge(spark, base, old, placed)
    new = _bucketed(placed, BUCKETS)
    held = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
    there = _stored_members(spark, base, held)
    n = new.select(F.col("board").alias("_b"), F.col("member").alias("_m"))
    rest = there.join(n, F.col("board").eqNullSafe(F.col("_b"))
                      & F.col("member").eqNullSafe(F.col("_m")), "left_anti")
    sinks.replace_partitions(rest.unionByName(new.select(*rest.columns)), f"{base}/members",
                             BUCKET, held)
    return touched
