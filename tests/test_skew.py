"""Hot keys: a board holding nearly all rows is ranked across many tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from evtide.operators import keyed, mutations


def _skewed_board(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("board"),
                                   F.format_string("m%05d", "id").alias("member"),
                                   ((F.col("id") * 7919) % 1000).cast("double").alias("score"))
    cold = spark.range(30).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))
                                  .alias("board"),
                                  F.format_string("m%05d", "id").alias("member"),
                                  (F.col("id") % 4).cast("double").alias("score"))
    return hot.unionByName(cold)


def test_hot_board_is_split_and_ranked_exactly(spark):
    b = _skewed_board(spark)
    ranked = keyed.board_ranks(b, num_partitions=6)
    w = Window.partitionBy("board").orderBy("score", "member")
    want = {(r.board, r.member): r.rk for r in
            b.select("board", "member", (F.row_number().over(w) - 1).alias("rk")).collect()}
    got = {(r.board, r.member): r["rank"] for r in ranked.collect()}
    assert got == want
    # the hot board really spans several range partitions
    spans = (b.repartitionByRange(6, "board", "score", "member")
             .withColumn("p", F.spark_partition_id())
             .filter(F.col("board") == "hot").select("p").distinct().count())
    assert spans >= 3


def test_reverse_ranks_and_sizes_on_hot_board(spark):
    b = _skewed_board(spark)
    r = keyed.with_ranks(b).filter(F.col("board") == "hot")
    assert r.agg(F.min("rank"), F.max("rank")).first() == (0, 2999)
    assert r.filter(F.col("rank") + F.col("reverse_rank") != 2999).count() == 0


def test_dense_ids_across_partitions(spark):
    batch = spark.range(0, 5000, numPartitions=13).select(F.col("id").alias("x"))
    out = mutations.assign_ids(batch, base=1000)
    agg = out.agg(F.min("id"), F.max("id"), F.countDistinct("id"), F.count(F.lit(1))).first()
    assert tuple(agg) == (1001, 6000, 5000, 5000)
