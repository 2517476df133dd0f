"""Connected components of a link table, by alternating star contractions.

Each round links every node to the smallest neighbour seen from it (large
star: the larger neighbours; small star: the smaller ones and itself). A hot
node is never gathered: its smallest neighbour is a pre-aggregated minimum,
joined back to its links, which are dealt over ``SALTS`` tasks by their other
end (and further by adaptive execution, where these are still large). Each
round's links are written to the shared folder and those before deleted; the
loop ends when a round changes nothing, after a number of rounds that grows
with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import materialise, release

#: Tasks that a node's links are dealt over.
SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (u, v) with the column m of ``least`` (u, m)."""
    salts = F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(
        least.withColumn("salt", F.explode(salts)), ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (_with_least(both, least).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v")))


def _mark(links: DataFrame):
    r = links.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame) -> DataFrame:
    """(u, v): every node of ``links`` (bigint u, v) but each component's
    smallest, with that smallest node. Self links and repeats are ignored."""
    now = materialise(links.select("u", "v").where("u != v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        last = now
        now = materialise(_small_star(_large_star(now)).where("u != v").distinct(), "links")
        before, mark = mark, _mark(now)
        release(last)
        if before == mark:
            break
    return now
