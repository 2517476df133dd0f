"""Reserved id blocks: dense, unique, repeatable."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from evtide.operators import mutations
from evtide.session import delete_path, scratch_path
from evtide.sources import idblocks, schemas


def test_blocks_follow_one_another(spark):
    path = scratch_path(spark, "ids")
    assert idblocks.high_water(spark, path, 7) == 7
    assert idblocks.reserve(spark, path, 5, start=100) == 100
    assert idblocks.reserve(spark, path, 3, "a-0") == 105
    assert idblocks.reserve(spark, path, 3, "a-0") == 105       # a repeated batch
    assert idblocks.reserve(spark, path, 0, "a-1") == 108       # nothing to number
    assert idblocks.reserve(spark, path, 0, "a-1") == 108
    assert idblocks.reserve(spark, path, 2) == 108
    assert idblocks.reserve(spark, path, 4, "a-0") == 110       # needs another number now
    assert idblocks.high_water(spark, path) == 114
    with pytest.raises(ValueError):
        idblocks.reserve(spark, path, 1, "a/b")


def test_a_broken_off_reservation_leaves_no_gap(spark, monkeypatch):
    path = scratch_path(spark, "ids")
    idblocks.reserve(spark, path, 5)
    with monkeypatch.context() as m:
        m.setattr(idblocks, "_take", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            idblocks.reserve(spark, path, 3, "s-0")             # its note is written already
    assert idblocks.reserve(spark, path, 2, "other") == 5
    assert idblocks.reserve(spark, path, 3, "s-0") == 7
    assert idblocks.reserve(spark, path, 3, "s-0") == 7


def test_jobs_at_once_share_no_id(spark):
    path = scratch_path(spark, "ids")
    idblocks.reserve(spark, path, 1)
    # one wins the block, the others see it and go on
    assert idblocks._take(spark, path, 2, 4, "x") and not idblocks._take(spark, path, 2, 9, "y")
    with ThreadPoolExecutor(4) as pool:
        bases = list(pool.map(lambda k: idblocks.reserve(spark, path, 3, f"w-{k}"), range(8)))
    assert len(set(bases)) == 8 and all((b - 4) % 3 == 0 for b in bases)


def test_old_blocks_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(idblocks, "KEEP", 3)
    path = scratch_path(spark, "ids")
    for k in range(8):
        assert idblocks.reserve(spark, path, 2, f"s-{k}") == 2 * k
    assert len(idblocks._blocks(spark, path)) == 3
    assert idblocks.reserve(spark, path, 2, "s-7") == 14
    delete_path(spark, path)


def test_ingest_asks_no_table_for_ids(spark):
    users = spark.createDataFrame([(1, "u", None)], schemas.USERS)
    types = spark.createDataFrame([(1, "click")], schemas.EVENT_TYPES)
    records = spark.createDataFrame([(1, "click", None, None)] * 3, schemas.INGEST_RECORD)
    path = scratch_path(spark, "ids")
    got = [mutations.ingest_events(records, users, types, id_blocks=path, owner=o,
                                   base_id=50).table for o in ("a", "b", "a")]
    assert [sorted(r.id for r in g.collect()) for g in got] == [
        [51, 52, 53], [54, 55, 56], [51, 52, 53]]
