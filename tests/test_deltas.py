"""The rollup kept by signed changes equals the full rebuild after every batch."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from evtide.operators import deltas, rollup
from evtide.session import scratch_path
from evtide.sources import schemas

AS_OF = "2024-02-01 00:00:00"
START = dt.datetime(2024, 1, 30, 20)


def row(rng, i):
    page = rng.choice(['{"page":"/a"}', '{"page":null}', '{"page":"unknown"}', "{}", None])
    at = START + dt.timedelta(minutes=rng.randrange(300))
    return (i, rng.randrange(4), rng.randrange(1, 4), page, at)


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], schemas.EVENT_TYPES)   # 3 has no name


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENTS)


def got(df):
    return sorted(map(tuple, df.select(*schemas.ROLLUP.fieldNames()).collect()), key=str)


def check(spark, base, rows, types, as_of=AS_OF):
    events = frame(spark, list(rows.values()))
    assert got(deltas.current(spark, base, types, as_of, events=events)) == got(
        rollup.stats_rollup(events, types, as_of))


def test_batches_of_every_kind(spark, types):
    rng, base = random.Random(3), scratch_path(spark, "deltas")
    rows = {i: row(rng, i) for i in range(60)}
    check(spark, base, {}, types)
    deltas.record(deltas.changes(frame(spark, list(rows.values()))), base)
    deltas.apply(spark, base)
    check(spark, base, rows, types)

    before = frame(spark, list(rows.values()))
    ids = rng.sample(sorted(rows), 20)
    for i in ids:
        rows[i] = (*rows[i][:2], rng.randrange(1, 4), '{"page":"/new"}', rows[i][4])
    listed = spark.createDataFrame([(i,) for i in [*ids, ids[0], 999]], "id long")
    deltas.record(deltas.update_changes(before, frame(spark, list(rows.values())), listed), base)

    # a delete waits beside the update and both are applied at once
    before = frame(spark, list(rows.values()))
    gone = rng.sample(sorted(rows), 25)
    deltas.record(deltas.delete_changes(
        before, spark.createDataFrame([(i,) for i in gone], "id long")), base)
    for i in gone:
        del rows[i]
    deltas.apply(spark, base)
    check(spark, base, rows, types)

    # late and future rows
    new = {100: (100, 1, 1, None, dt.datetime(2024, 1, 3, 1)),
           101: (101, 1, 1, None, dt.datetime(2031, 1, 3, 1)),
           102: (102, 2, 2, '{"page":"/a"}', dt.datetime(2023, 1, 3, 1))}
    deltas.record(deltas.changes(frame(spark, list(new.values()))), base)
    assert len(deltas.apply(spark, base)) == 3
    rows |= new
    check(spark, base, rows, types)
    # the lookback begins within an hour that has events
    check(spark, base, rows, types, as_of=START + dt.timedelta(days=30, minutes=75, seconds=3))

    cutoff = START + dt.timedelta(minutes=130)
    deltas.drop_before(spark, base, cutoff, frame(spark, list(rows.values())))
    rows = {i: r for i, r in rows.items() if r[4] >= cutoff}
    check(spark, base, rows, types)


def test_a_batch_counts_once_however_often_it_is_replayed(spark, types):
    base = scratch_path(spark, "deltas")
    rows = {i: (i, i, 1, None, START) for i in range(3)}
    events = frame(spark, list(rows.values()))
    for _ in range(3):
        assert deltas.record(deltas.changes(events), base, seq=1, writer="stream") == 1
        assert len(deltas.apply(spark, base)) == 1
        check(spark, base, rows, types)
    # another writer has numbers of its own
    assert deltas.record(deltas.changes(events.where("id = 2"), -1), base) == 1
    deltas.apply(spark, base)
    del rows[2]
    check(spark, base, rows, types)
    # an hour may lose its last event and still knows what it has counted
    deltas.record(deltas.changes(events.where("id < 2"), -1), base)
    deltas.apply(spark, base)
    deltas.record(deltas.changes(events), base, seq=1, writer="stream")
    deltas.apply(spark, base)
    check(spark, base, {}, types)


def test_broken_off_between_ledger_and_rollup(spark, types, monkeypatch):
    base = scratch_path(spark, "deltas")
    rows = {i: (i, i, 1, '{"page":"/x"}', START) for i in range(3)}
    deltas.record(deltas.changes(frame(spark, list(rows.values()))), base)
    monkeypatch.setattr(deltas, "hours_of", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        deltas.apply(spark, base)
    monkeypatch.undo()
    deltas.apply(spark, base)
    check(spark, base, rows, types)


def test_only_touched_hours_are_read_and_written(spark, types):
    base = scratch_path(spark, "deltas")
    rows = [(i, i, 1, None, START + dt.timedelta(hours=i % 5)) for i in range(20)]
    deltas.record(deltas.changes(frame(spark, rows)), base)
    deltas.apply(spark, base)

    def files(part):
        root = f"{base}/{part}".removeprefix("file:")
        return {h: sorted(os.listdir(f"{root}/{h}")) for h in os.listdir(root)
                if h.startswith("hour_key=")}
    old = {p: files(p) for p in ("ledger", "rollup")}
    deltas.record(deltas.changes(frame(spark, rows[2:3]), -1), base)
    waiting = deltas.pending(spark, base, deltas._batches(spark, base))
    hours = deltas.touched(waiting)
    assert hours == ["2024-01-30T22"]
    plan = deltas.summed(deltas._ledger(spark, base), waiting, hours)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in text.split("\n") if "FileScan" in x and "hour_key#" in x]
    assert scans and all("PartitionFilters: [" in x and "2024-01-30T22" in x for x in scans)
    assert "Exchange SinglePartition" not in text
    assert deltas.apply(spark, base) == hours
    for part in old:
        now = files(part)
        assert set(now) == set(old[part])
        assert {h for h in now if now[h] != old[part][h]} == {"hour_key=2024-01-30T22"}


def test_changes_before_the_lookback_are_left_out(spark, types):
    base = scratch_path(spark, "deltas")
    events = frame(spark, [(1, 1, 1, None, START), (2, 1, 1, None, dt.datetime(2020, 1, 1))])
    deltas.record(deltas.changes(events), base, since=dt.datetime(2024, 1, 2, 0, 30))
    assert deltas.apply(spark, base) == ["2024-01-30T20"]
    assert deltas.current(spark, base, types, AS_OF).agg(F.sum("total_count")).first()[0] == 1
