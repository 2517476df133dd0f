"""Small cases from the reference's own tests and our deviations (FIXTURES.md)."""

import datetime as dt
import uuid

import pytest

from evtide.operators import keyed, metrics, mutations, reads, report, rollup
from evtide.sources import schemas

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


@pytest.fixture()
def dims(spark):
    users = spark.createDataFrame(
        [(i, f"user_{i}", T0) for i in (1, 2, 3)], schemas.USERS)
    types = spark.createDataFrame([(1, "click"), (2, "view"), (3, "test_event")],
                                  schemas.EVENT_TYPES)
    return users, types


def ev(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENTS)


def test_ingest_resolves_defaults_and_rejects(spark, dims):
    users, types = dims
    recs = spark.createDataFrame([
        (1, "test_event", "2024-01-10T12:00:00Z", '{"action":"click","button":"submit"}'),
        (1, "no_such_type", "2024-01-10T12:00:00Z", None),
        (999999, "click", "2024-01-10T12:00:00Z", None),
        (2, "view", None, None), (2, "view", "soon", None)], schemas.INGEST_RECORD)
    out = mutations.ingest_events(recs, users, types, as_of=T0 + dt.timedelta(hours=1),
                                  base_id=10)
    acc = out.table.orderBy("seq").collect()
    assert [r.event_type_id for r in acc] == [3, 2]
    assert sorted(r.id for r in acc) == [11, 12]
    assert acc[1].timestamp == T0 + dt.timedelta(hours=1)
    rej = {r.reason for r in out.report.collect()}
    assert rej == {"unknown_event_type", "unknown_user", "invalid_timestamp"}
    assert acc[0].timestamp == T0


def test_update_missing_and_partial(spark, dims):
    _, types = dims
    e = ev(spark, [(1, 1, 1, '{"page":"a"}', T0)])
    upd = spark.createDataFrame([(1, None, '{"page":"b"}', None), (7, 2, None, None)],
                                schemas.EVENT_UPDATE)
    out = mutations.update_events(e, upd, types)
    row = out.table.collect()[0]
    assert row.event_type_id == 1 and row.metadata == '{"page":"b"}'
    st = {r.event_id: r.status for r in out.report.collect()}
    assert st == {1: "updated", 7: "not_found"}


def test_rename_statuses(spark, dims):
    users, _ = dims
    ren = spark.createDataFrame([(1, "user_2"), (2, None), (5, "x"), (3, "fresh")],
                                schemas.RENAME)
    out = mutations.rename(users, ren)
    st = {r.id: r.status for r in out.report.collect()}
    assert st == {1: "name_exists", 2: "ok", 5: "not_found", 3: "ok"}
    names = {r.id: r.name for r in out.table.collect()}
    assert names == {1: "user_1", 2: "user_2", 3: "fresh"}


def test_delete_missing_and_cascade(spark, dims):
    users, _ = dims
    e = ev(spark, [(1, 1, 1, None, T0), (2, 2, 1, None, T0)])
    out = mutations.delete_by_id(e, spark.createDataFrame([(1,), (9,)], "id long"))
    kept, missing = out.table, out.report
    assert [r.id for r in kept.collect()] == [2]
    assert [r.id for r in missing.collect()] == [9]
    u2, e2, _ = mutations.delete_users_cascade(users, e, spark.createDataFrame([(2,)], "id long"))
    assert sorted(r.id for r in u2.collect()) == [1, 3]
    assert [r.id for r in e2.collect()] == [1]


def test_retention_is_strict(spark):
    now = T0
    e = ev(spark, [(1, 1, 1, None, now - dt.timedelta(hours=2)),
                   (2, 1, 1, None, now - dt.timedelta(hours=1)), (3, 1, 1, None, now)])
    out = mutations.retention(e, now)
    assert out.report.collect()[0].deleted == 2
    assert [r.id for r in out.table.collect()] == [3]
    empty = mutations.retention(e.limit(0), now + dt.timedelta(days=1))
    assert empty.report.collect()[0].deleted == 0


def test_user_events_limits(spark, dims):
    _, types = dims
    e = ev(spark, [(i, 1 if i < 3 else 2, 1, None, T0 + dt.timedelta(minutes=i))
                   for i in range(1, 6)])
    assert reads.user_events(e, types, 1).count() == 2
    assert reads.user_events(e, types, 2, limit=2).count() == 2
    assert reads.user_events(e, types, 3).count() == 0


def test_users_paging_and_cursor(spark):
    users = spark.createDataFrame([(i, f"user_0{i}", T0) for i in range(1, 6)], schemas.USERS)
    assert reads.users_page(users, limit=3).count() == 3
    assert reads.users_page(users, offset=2).count() == 3
    p = reads.users_page(users, limit=2, offset=1).collect()
    assert [r.name for r in p] == ["user_02", "user_03"]
    sizes, cursor = [], None
    while True:
        page = reads.users_cursor(users, cursor, 2).collect()
        sizes.append(len(page))
        cursor = page[-1].next_name
        if cursor is None:
            break
    assert sizes == [2, 2, 1]


def test_cursor_ties(spark):
    e = ev(spark, [(i, 1, 1, None, T0) for i in (1, 2, 3)])
    first = reads.events_cursor(e, limit=2).collect()
    assert [r.id for r in first] == [3, 2]
    nxt = reads.events_cursor(e, first[-1].next_timestamp, first[-1].next_id, limit=2).collect()
    assert [r.id for r in nxt] == [1]
    skip = reads.events_cursor(e, first[-1].next_timestamp, limit=2, ties="skip").collect()
    assert skip == []


def test_leaderboard_example(spark):
    b = spark.createDataFrame([("lb", "player1", 100.0), ("lb", "player2", 85.0),
                               ("lb", "player3", 120.0)], schemas.BOARD)
    ranks = {r.member: (r.rank, r.reverse_rank) for r in keyed.with_ranks(b).collect()}
    assert ranks["player1"][0] == 1 and ranks["player2"][0] == 0 and ranks["player3"][0] == 2
    assert ranks["player3"][1] == 0
    assert [r.member for r in keyed.top(b, 2).orderBy("rank").collect()] == ["player3", "player1"]
    assert keyed.top(b, 0).count() == 0
    inc = spark.createDataFrame([("lb", "player2", 20.0)], "board string, member string, delta double")
    s = {r.member: r.score for r in keyed.add_scores(b, inc).collect()}
    assert s["player2"] == 105.0
    g = {r.member: r.rank for r in keyed.global_rank(b, num_partitions=2).collect()}
    assert g == {"player2": 0, "player1": 1, "player3": 2}


def test_sets_and_lists(spark):
    s = spark.createDataFrame([("k", "a"), ("k", "b")], schemas.KEYED_SET)
    s = keyed.set_add(s, spark.createDataFrame([("k", "a")], schemas.KEYED_SET))
    assert keyed.set_sizes(s).collect()[0].size == 2
    s = keyed.set_remove(s, spark.createDataFrame([("k", "a")], schemas.KEYED_SET))
    assert keyed.set_sizes(s).collect()[0].size == 1
    lst = spark.createDataFrame([("u", "view_page", 0), ("u", "login", 1), ("u", "logout", 2)],
                                "key string, value string, pos int")
    assert [r.value for r in keyed.list_range(lst, 0, 1).orderBy("pos").collect()] == \
        ["view_page", "login"]
    assert keyed.list_index(lst, -1).collect()[0].value == "logout"
    popped, rest = keyed.list_pop(lst, 1)
    assert popped.collect()[0].value == "view_page" and rest.count() == 2


def test_report_rules(spark, dims):
    _, types = dims
    # Q4: one user, 2 types, 3 hours each -> report unique_users 6
    rows = [(i, 1, t, '{"page":"/a"}', T0 + dt.timedelta(hours=h))
            for i, (t, h) in enumerate([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)])]
    e = ev(spark, rows)
    r = rollup.stats_rollup(e, types, as_of=T0)
    rep = report.stats_report(r, T0, T0 + dt.timedelta(hours=2, minutes=15), now=T0)
    tot = [x for x in rep.collect() if x.result_type == "totals"][0]
    assert tot["count"] == 6 and tot.unique_users == 6
    exact = metrics.unique_users(e, types, T0, T0 + dt.timedelta(hours=3)).collect()[0]
    assert exact.unique_users == 1
    # empty window for an absent type: totals 0 and 0, no event rows
    rep2 = report.stats_report(r, T0, T0 + dt.timedelta(hours=2), "absent", now=T0).collect()
    assert [(x.result_type, x["count"], x.unique_users) for x in rep2
            if x.result_type != "pages"] == [("totals", 0, 0)]


def test_page_rollup_unknown_merge(spark, dims):
    _, types = dims
    e = ev(spark, [(1, 1, 1, '{"x":1}', T0), (2, 1, 1, '{"page":null}', T0),
                   (3, 1, 1, '{"page":"unknown"}', T0)])
    pages = rollup.page_rollup(e, as_of=T0).collect()
    assert [(p.page, p.page_count) for p in pages] == [("unknown", 2)]


def test_report_to_hour_inclusive(spark, dims):
    _, types = dims
    e = ev(spark, [(1, 1, 1, None, dt.datetime(2024, 1, 20, 18, 59, 59))])
    r = rollup.stats_rollup(e, types, as_of=dt.datetime(2024, 1, 21))
    rep = report.stats_report(r, "2024-01-20 10:00:00", "2024-01-20 18:15:00",
                              now="2024-01-21 00:00:00").collect()
    assert [x["count"] for x in rep if x.result_type == "totals"] == [1]


def test_top_pages_tiebreak(spark, dims):
    _, types = dims
    e = ev(spark, [(i, 1, 1, f'{{"page":"/{p}"}}', T0) for i, p in enumerate("bacd")])
    got = [r.page for r in metrics.top_pages(e, types, T0, T0, limit=2).collect()]
    assert got == ["/a", "/b"]


def test_streaming_rollup_equals_batch(spark, tmp_path, dims):
    from evtide.streaming import streams
    _, types = dims
    rows = [(i, i % 3, 1 + i % 2, None, T0 + dt.timedelta(minutes=7 * i)) for i in range(60)]
    src = str(tmp_path / "src")
    ev(spark, rows).repartition(3).write.parquet(src)
    ev(spark, [(-1, -1, 0, None, T0 + dt.timedelta(days=400))]).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    counts = streams.windowed_type_counts(
        streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1), "10 days")
    streams.append_stream(counts, out, f"t-{uuid.uuid4().hex}", available_now=True
                          ).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out)
                 .select("window_start", "event_type_id", "total_count", "unique_users").collect())
    batch = metrics.hourly_summary(ev(spark, rows), types, None, None)
    want = sorted(tuple(r) for r in batch.select("hour_bucket", "event_type_id", "total_count",
                                                 "unique_users").collect())
    assert got == want


def test_delete_in_place_rewrites_only_touched_days(spark):
    import os
    from evtide.session import scratch_path
    from evtide.sources import sinks
    day = dt.timedelta(days=1)
    e = ev(spark, [(1, 1, 1, None, T0), (2, 1, 1, None, T0 + day), (3, 2, 1, None, T0 + day),
                   (4, 2, 1, None, T0 + 2 * day)])
    path = scratch_path(spark, "t-del")
    sinks.append_events(e, path)
    before = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path)
              if d.startswith("event_date=")}
    missing = mutations.delete_events_in_place(
        path, spark.createDataFrame([(1,), (3,), (42,)], "id long"))
    assert [r.id for r in missing.collect()] == [42]
    got = sorted(r.id for r in spark.read.parquet(path).collect())
    assert got == [2, 4]
    days = sorted(d for d in os.listdir(path) if d.startswith("event_date="))
    assert days == [f"event_date={(T0 + day).date()}", f"event_date={(T0 + 2 * day).date()}"]
    untouched = f"event_date={(T0 + 2 * day).date()}"
    assert sorted(os.listdir(os.path.join(path, untouched))) == before[untouched]


def test_updates_fold_in_sequence(spark, dims):
    _, types = dims
    e = ev(spark, [(1, 1, 1, '{"page":"a"}', T0)])
    upd = spark.createDataFrame(
        [(1, 2, None, None, 0), (1, None, '{"page":"b"}', None, 1), (1, 99, None, None, 2)],
        "event_id long, event_type_id int, metadata string, timestamp timestamp_ntz, seq long")
    out = mutations.update_events(e, upd, types)
    row = out.table.collect()[0]
    assert (row.event_type_id, row.metadata) == (2, '{"page":"b"}')
    st = {r.seq: r.status for r in out.report.collect()}
    assert st == {0: "updated", 1: "updated", 2: "unknown_event_type"}


def test_rename_last_ok_command_wins(spark, dims):
    users, _ = dims
    ren = spark.createDataFrame([(1, "first", 0), (1, "second", 1)], "id long, name string, seq long")
    out = mutations.rename(users, ren)
    assert {r.id: r.name for r in out.table.collect()}[1] == "second"


def test_retention_in_place_drops_old_days(spark):
    import os
    from evtide.session import scratch_path
    from evtide.sources import sinks
    day = dt.timedelta(days=1)
    e = ev(spark, [(1, 1, 1, None, T0 - 2 * day), (2, 1, 1, None, T0 - day),
                   (3, 1, 1, None, T0 - dt.timedelta(hours=1)), (4, 1, 1, None, T0),
                   (5, 1, 1, None, T0 + day)])
    path = scratch_path(spark, "t-ret")
    sinks.append_events(e, path)
    later = f"event_date={(T0 + day).date()}"
    before = sorted(os.listdir(os.path.join(path, later)))
    rep = mutations.retention_in_place(path, T0).collect()[0]
    assert rep.deleted == 3
    days = sorted(d for d in os.listdir(path) if d.startswith("event_date="))
    assert days == [f"event_date={T0.date()}", later]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [4, 5]
    assert sorted(os.listdir(os.path.join(path, later))) == before


def test_broken_rewrite_is_carried_to_its_end(spark, monkeypatch):
    """A failure after the overwrite, before the emptied days are gone."""
    from evtide.session import scratch_path
    from evtide.sources import sinks
    day = dt.timedelta(days=1)
    path = scratch_path(spark, "t-fault")
    sinks.append_events(ev(spark, [(1, 1, 1, None, T0), (2, 1, 1, None, T0 + day),
                                   (3, 2, 1, None, T0 + day)]), path)
    real, calls = sinks.delete_path, []

    def failing(spark_, p):
        calls.append(p)
        raise OSError("store unavailable")
    monkeypatch.setattr(sinks, "delete_path", failing)
    with pytest.raises(OSError):
        mutations.delete_events_in_place(path, spark.createDataFrame([(1,), (3,)], "id long"))
    assert calls
    monkeypatch.setattr(sinks, "delete_path", real)
    assert sinks.finish_rewrite(spark, path)
    assert not sinks.finish_rewrite(spark, path)
    assert [r.id for r in sinks.read_events(spark, path).collect()] == [2]


def test_readers_do_not_see_emptied_days(spark, monkeypatch):
    """Between the overwrite and the removal of a day that lost all its rows."""
    from evtide.session import scratch_path
    from evtide.sources import sinks
    path = scratch_path(spark, "t-fault")
    sinks.append_events(ev(spark, [(1, 1, 1, None, T0), (2, 1, 1, None, T0 + dt.timedelta(days=1))]),
                        path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "delete_path", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            mutations.delete_events_in_place(path, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in sinks.read_events(spark, path).collect()] == [2]
    sinks.finish_rewrite(spark, path)
    assert [r.id for r in sinks.read_events(spark, path).collect()] == [2]


def test_failure_before_the_note_changes_nothing(spark, monkeypatch):
    from evtide.session import scratch_path
    from evtide.sources import sinks
    path = scratch_path(spark, "t-fault")
    sinks.append_events(ev(spark, [(1, 1, 1, None, T0), (2, 1, 1, None, T0)]), path)

    def failing(*_):
        raise OSError("store unavailable")
    monkeypatch.setattr(sinks, "_write_note", failing)
    with pytest.raises(OSError):
        mutations.delete_events_in_place(path, spark.createDataFrame([(1,)], "id long"))
    monkeypatch.undo()
    assert not sinks.finish_rewrite(spark, path)
    assert sorted(r.id for r in sinks.read_events(spark, path).collect()) == [1, 2]


def test_rename_claims_of_invalid_commands_do_not_count(spark, dims):
    users, _ = dims
    ren = spark.createDataFrame([(77, "fresh", 0), (1, "fresh", 1), (2, "fresh", 2),
                                 (1, "fresh", 3), (3, "n" * 101, 4)],
                                "id long, name string, seq long")
    out = mutations.rename(users, ren, longest=100)
    assert {r.seq: r.status for r in out.report.collect()} == {
        0: "not_found", 1: "ok", 2: "name_exists", 3: "ok", 4: "name_too_long"}
    assert {r.id: r.name for r in out.table.collect()}[1] == "fresh"


def test_names_are_checked_on_creation(spark, dims):
    users, _ = dims
    batch = spark.createDataFrame([(0, None), (1, "x" * 300), (2, "new"), (3, None), (4, "new")],
                                  "seq long, name string")
    out = mutations.create_named(batch, users, base_id=3, longest=100)
    assert {r.seq: r.status for r in out.report.collect()} == {
        0: "missing_name", 1: "name_too_long", 2: "created", 3: "missing_name",
        4: "duplicate_in_batch"}
    assert [(r.id, r.name) for r in out.table.collect()] == [(4, "new")]


def test_member_moved_twice_goes_to_the_first_target(spark):
    s = spark.createDataFrame([("a", "m"), ("a", "n")], schemas.KEYED_SET)
    moves = spark.createDataFrame([("a", "c", "m", 2), ("a", "b", "m", 1)],
                                  "src string, dst string, member string, seq long")
    assert sorted(map(tuple, keyed.set_move(s, moves).collect())) == [("a", "n"), ("b", "m")]


def test_null_board_and_ends_of_ranges(spark):
    rows = [(b, f"m{i}", float(i)) for b in (None, "x") for i in range(6)]
    b = spark.createDataFrame(rows, "board string, member string, score double")
    assert keyed.with_ranks(b).filter("board is null").count() == 6

    def members(df):
        return sorted((r.board or "", r.member, r["rank"]) for r in df.collect())
    for start, stop, reverse in ((0, 2, False), (-2, -1, False), (-3, -2, True), (1, -2, False),
                                 (1, -2, True), (-4, 3, False), (4, 9, True)):
        want = []
        for name in ("", "x"):
            order = [f"m{i}" for i in range(6)][::-1 if reverse else 1]
            lo = start if start >= 0 else 6 + start
            hi = stop if stop >= 0 else 6 + stop
            want += [(name, m, k) for k, m in enumerate(order) if lo <= k <= hi]
        assert members(keyed.rank_range(b, start, stop, reverse)) == sorted(want)
    left = keyed.remove_rank_range(b, 0, 3)
    assert sorted((r.board or "", r.member) for r in left.collect()) == [
        (n, m) for n in ("", "x") for m in ("m4", "m5")]
