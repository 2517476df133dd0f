"""Row numbers and running sums against a plain loop."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from evtide.operators.running import running


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    names = [None, *(["hot"] * 25), *(f"g{i}" for i in range(24))]
    return [(rng.choice(names), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]),
             rng.randrange(1000), i, rng.choice([None, *range(-5, 6)])) for i in range(3000)]


def expected(rows, key):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    out = {}
    for rs in groups.values():
        total = 0
        for p, r in enumerate(sorted(rs, key=lambda r: (r[2], r[3]))):
            total += r[4] or 0
            out[r[3]] = (p, total, len(rs))
    return out


@pytest.mark.parametrize("group", [[], ["g"], ["f"], ["g", "f"]])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_running_equals_a_loop(spark, table, group, batch):
    df = spark.createDataFrame(table, "g string, f double, o int, i int, v int")
    where = {"g": 0, "f": 1}

    def key(r):
        return tuple("nan" if r[where[c]] != r[where[c]] else r[where[c]] for c in group)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(batch))
    try:
        got = running(df, group, [F.col("o"), F.col("i")], "p", {"s": "v"}, "n", before={"b": "v"}).collect()
    finally:
        spark.conf.set(conf, before)
    assert {r.i: (r.p, r.s, r.n) for r in got} == expected(table, key)
    assert all(r.b == r.s - (r.v or 0) for r in got)
    assert len(got) == len(table)


def test_a_hot_group_is_cut_and_rows_are_shuffled_once(spark, table):
    df = spark.createDataFrame(table, "g string, f double, o int, i int, v int")
    out = running(df, ["g"], [F.col("o"), F.col("i")], "p", size="n")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    parts = out.where("g = 'hot'").select(F.spark_partition_id().alias("x")).distinct().count()
    assert parts >= 3


def test_sums_wrap_and_an_empty_table_stays_empty(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,)], "v bigint")
    got = running(df, [], [F.col("v").desc()], sums={"s": "v"}).collect()
    assert [r.s for r in got] == [2**63 - 1, -2**63]
    none = running(df.limit(0), ["v"], [F.col("v")], "p", size="n")
    assert none.collect() == [] and none.columns == ["v", "p", "n"]
