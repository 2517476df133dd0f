"""Bitmaps of users: exact counts and set algebra against Python sets."""

import random

import pytest

from evtide.operators import bitmaps, deltas
from evtide.plans.catalog import QUERIES
from evtide.plans.registry import _t
from evtide.session import scratch_path

SF = "/root/testdata/sf0.001"
EDGES = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 10**12, -10**12, 7, 8]


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(8)
    ids = EDGES + [rng.randrange(-10**5, 10**5) for _ in range(400)]
    held = {"a": set(ids), "b": set(ids[::2]) | {99}, "c": {5}}
    rows = [(k, i) for k, v in held.items() for i in v] * 2 + [("c", None), ("d", None)]
    return held, bitmaps.sets_of(spark.createDataFrame(rows, "key string, user_id long"))


def users(df):
    got = [r.user_id for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ids_come_back_from_their_bits(sets):
    held, df = sets
    for k, v in held.items():
        assert users(bitmaps.members(df.where(df.key == k))) == v


def test_set_algebra(sets):
    held, df = sets
    a, b, c = (held[k] for k in "abc")
    assert users(bitmaps.members(bitmaps.union(df, ["a", "b", "none"]))) == a | b
    assert users(bitmaps.members(bitmaps.intersect(df, ["a", "b", "a"]))) == a & b
    assert users(bitmaps.members(bitmaps.intersect(df, ["a", "c"]))) == a & c
    assert users(bitmaps.members(bitmaps.intersect(df, ["a", "none"]))) == set()
    for first, others in (("a", "b"), ("b", "a"), ("ab", "c"), ("c", "d"), ("a", "a"), ("d", "a")):
        want = set().union(*(held.get(k, set()) for k in first)) - set().union(
            *(held.get(k, set()) for k in others))
        assert users(bitmaps.difference(df, list(first), list(others))) == want
        assert bitmaps.difference_size(df, list(first), list(others)).first()[0] == len(want)
    assert {r.key: r.n for r in bitmaps.sizes(df, "key", col="n").collect()} == {
        k: len(v) for k, v in held.items()}


def test_ledger_and_events_give_the_same_bitmaps(spark):
    t, base = _t(spark, SF), scratch_path(spark, "ledger")
    some = t.hot.where("timestamp < '2024-01-05'")
    deltas.record(deltas.changes(some), base)
    deltas.record(deltas.changes(some.where("id % 3 = 0"), -1), base)
    deltas.apply(spark, base)

    def rows(df):
        return sorted((r.event_type_id, r.hour_bucket, r.bucket, bytes(r.users))
                      for r in df.collect())
    assert rows(bitmaps.from_ledger(deltas._ledger(spark, base))) == rows(
        bitmaps.hourly(some.where("id % 3 != 0")))


def test_lookback_and_empty(spark):
    t = _t(spark, SF)
    some = bitmaps.hourly(t.events, "2024-02-05 00:00:00", 30)
    assert str(some.agg({"hour_bucket": "min"}).first()[0]) >= "2024-01-06"
    none = bitmaps.exact_unique_users(bitmaps.hourly(t.events.limit(0)), t.event_types,
                                      now="2024-02-05 00:00:00")
    assert [tuple(r) for r in none.collect()] == [("totals", None, 0)]


@pytest.mark.parametrize("name", ["report_exact_users_bitmaps", "active_users_month",
                                  "active_users_gone", "active_sizes_bitmaps"])
def test_only_the_snapshot_is_read(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and not any("user_id" in x or "metadata" in x for x in scans)


def test_days_outside_the_range_are_pruned(spark):
    plan = QUERIES["report_exact_users_bitmaps"](spark, SF)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
