"""Streaming forms without a registered query, parameter rules, generator."""

import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from evtide.functions.params import clamp_limit, resolve_offset
from evtide.functions.timefn import check_range, floor_hour
from evtide.operators import report
from evtide.sources import generate, schemas, sinks
from evtide.streaming import streams

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
RFC = "2024-01-10T15:00:00+03:00"     # T0 as a client may send it
RUN = uuid.uuid4().hex  # checkpoint names must not collide with earlier runs


def _events(spark, n=40, step_min=9):
    rows = [(i, i % 4, 1 + i % 2, '{"page":"/a"}', T0 + dt.timedelta(minutes=step_min * i))
            for i in range(n)]
    return spark.createDataFrame(rows, schemas.EVENTS)


def _types(spark):
    return spark.createDataFrame([(1, "click"), (2, "view")], schemas.EVENT_TYPES)


def test_parameter_rules():
    with pytest.raises(ValueError):
        check_range("2024-01-02", "2024-01-01")
    check_range(None, "2024-01-01")
    assert floor_hour("2024-01-10 06:30:59") == dt.datetime(2024, 1, 10, 6)
    # RFC 3339 parameters are UTC, with a zone or without
    assert floor_hour("2024-01-10T06:30:00+05:30") == dt.datetime(2024, 1, 10, 1)
    check_range("2024-01-10T06:30:00Z", "2024-01-10 06:30:01")
    with pytest.raises(ValueError):
        check_range("2024-01-10T06:30:00-01:00", dt.datetime(2024, 1, 10, 7, 0, 0))
    assert clamp_limit(None) == 100 and clamp_limit(5000) == 1000
    assert resolve_offset(None, 3, 10) == 20 and resolve_offset(5, 3, 10) == 5
    assert resolve_offset(None, 0, 10) == 0
    frm, to, fr, tr = report.report_range(None, None, now="2024-02-05 10:20:00")
    assert to - frm == dt.timedelta(days=30) and tr == dt.datetime(2024, 2, 5, 10)


def _end_marker(spark, src):
    """An event long after all others, so that every window before it closes."""
    spark.createDataFrame([(-1, -1, 0, '{"page":"end"}', T0 + dt.timedelta(days=400))],
                          schemas.EVENTS).coalesce(1).write.mode("append").parquet(src)


def test_sliding_windows_match_batch(spark, tmp_path):
    e = _events(spark)
    src = str(tmp_path / "src")
    e.repartition(2).write.parquet(src)
    _end_marker(spark, src)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
    agg = streams.windowed_type_counts(stream, "30 days", "1 hour", "30 minutes")
    out = str(tmp_path / "out")
    streams.append_stream(agg, out, f"slide-{RUN}", available_now=True).awaitTermination()
    got = {(r.window_start, r.event_type_id): (r.total_count, r.unique_users)
           for r in spark.read.parquet(out).collect()}
    b = (streams.with_event_time(e)
         .groupBy(F.window(streams.EVENT_TIME, "1 hour", "30 minutes").alias("w"), "event_type_id")
         .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u")))
    want = {(r.w.start, r.event_type_id): (r.n, r.u) for r in b.collect()}
    assert got == want


def test_page_rollup_stream_upserts(spark, tmp_path):
    rows = [(i, 1, 1, ['{"page":"/a"}', '{"page":null}', '{}'][i % 3],
             T0 + dt.timedelta(minutes=20 * i)) for i in range(30)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    e = spark.createDataFrame(rows, schemas.EVENTS)
    e.repartition(3).write.parquet(src)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
    agg = streams.windowed_page_counts(stream, "30 days")
    streams.upsert_stream(agg, out, f"pages-{RUN}", available_now=True).awaitTermination()
    got = {(r.page, r.window_start): r.page_count
           for r in streams.latest_rows(spark, out, ["page", "window_start"]).collect()}
    from evtide.operators import rollup
    want = {(r.page, r.hour_bucket): r.page_count
            for r in rollup.page_rollup(e, as_of=T0).collect()}
    assert got == want


def test_stream_sessions_emit_closed_sessions(spark, tmp_path):
    rows = [(1, 1, 1, None, T0), (2, 1, 1, None, T0 + dt.timedelta(minutes=10)),
            (3, 1, 1, None, T0 + dt.timedelta(hours=2)),
            (4, 2, 1, None, T0 + dt.timedelta(days=3))]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.parquet(src)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS)
    s = streams.inactivity_sessions(stream, "30 minutes", watermark="1 hour")
    out = str(tmp_path / "out")
    streams.append_stream(s, out, f"sess-{RUN}", available_now=True).awaitTermination()
    got = sorted((r.user_id, r.events) for r in spark.read.parquet(out).collect())
    # user 1's two sessions are behind the watermark; user 2's is still open
    assert got == [(1, 1), (1, 2)]
    batch = sorted((r.user_id, r.events) for r in
                   streams.inactivity_sessions(spark.createDataFrame(rows, schemas.EVENTS))
                   .collect())
    assert batch == [(1, 1), (1, 2), (2, 1)]


def test_consumers_are_independent(spark, tmp_path):
    src = str(tmp_path / "log")
    _events(spark, 10).coalesce(1).write.parquet(src)
    seen = {"a": [], "b": []}

    def handler(name):
        def run(df, batch_id):
            seen[name].append((batch_id, df.count()))
        return run

    for name in ("a", "b"):
        streams.consume(streams.parquet_stream(spark, src, schemas.EVENTS), f"{name}-{RUN}",
                        handler(name), available_now=True).awaitTermination()
    assert seen["a"] == seen["b"] == [(0, 10)]
    _events(spark, 3).coalesce(1).write.mode("append").parquet(src)
    streams.consume(streams.parquet_stream(spark, src, schemas.EVENTS), f"a-{RUN}",
                    handler("a"), available_now=True).awaitTermination()
    assert seen["a"][-1] == (1, 3)     # consumer a resumes after its position


def test_scheduled_refresh_writes_versions(spark, tmp_path):
    """The clock ticks without any new event; only the last versions are kept."""
    e = _events(spark)
    base = str(tmp_path / "rollup")
    q = streams.scheduled_refresh(spark, lambda: e, lambda: _types(spark), base,
                                  every="1 second", name=f"refresh-{RUN}",
                                  as_of=T0 + dt.timedelta(days=1))
    seen = set()
    for _ in range(240):
        seen |= set(sinks.versions(spark, base))
        if len(seen) >= 3:
            break
        time.sleep(0.25)
    q.stop()
    assert len(seen) >= 3 and len(sinks.versions(spark, base)) <= 3
    snap = sinks.read_current(spark, base, schemas.ROLLUP)
    assert snap.filter("stat_type = 'event_type'").agg(F.sum("total_count")).first()[0] == 40


def test_incomplete_versions_are_not_read(spark, tmp_path):
    base = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        sinks.current_version(spark, base)
    first = sinks.write_version(spark.range(3), base)
    spark.range(9).write.parquet(f"{base}/v=99990101T000000000000-broken")
    (tmp_path / "v" / "v=99990101T000000000000-broken" / "_SUCCESS").unlink()
    assert sinks.current_version(spark, base) == first
    for n in range(4, 8):
        sinks.write_version(spark.range(n), base, keep=2)
    assert sinks.read_current(spark, base).count() == 7
    assert len(sinks.versions(spark, base)) == 2


def test_generator_is_deterministic(spark):
    users = generate.users(spark, 5, T0).select((F.col("id") - 1).alias("idx"),
                                                F.col("id").alias("user_id"))
    types = generate.event_types(spark, 103)
    names = [r.name for r in types.orderBy("id").collect()]
    assert names[0] == "user.registered" and names[100] == "user.registered_v2"
    assert len(set(names)) == 103
    a = generate.events(spark, 500, users, types, as_of=T0, num_partitions=3)
    b = generate.events(spark, 500, users, types, as_of=T0, num_partitions=7)
    key = ["seq", "user_id", "event_type", "timestamp", "metadata"]
    assert sorted(tuple(r) for r in a.select(key).collect()) == \
        sorted(tuple(r) for r in b.select(key).collect())
    rows = a.collect()
    assert all(T0 - dt.timedelta(days=30) <= r.timestamp < T0 for r in rows)
    prod = [r for r in rows if r.event_type.split(".")[0] in ("product", "order", "cart", "checkout")]
    assert prod and all('"product_id"' in r.metadata for r in prod)
    assert all('"product_id"' not in r.metadata for r in rows if r not in prod)


def test_bounded_stream_rollup_emits_only_exact_closed_hours(spark, tmp_path):
    from evtide.operators import metrics
    rows = [(i, i % 5, 1 + i % 2, None, T0 + dt.timedelta(minutes=17 * i)) for i in range(400)]
    src = str(tmp_path / "src")
    for part in range(4):  # arrives in time order: one file per slice, oldest first
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schemas.EVENTS).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
    agg = streams.windowed_type_counts(stream, "1 day").withColumnRenamed(
        "window_start", "hour_bucket")
    out = str(tmp_path / "out")
    streams.append_stream(agg, out, f"bounded-{RUN}", available_now=True).awaitTermination()
    got = {(r.hour_bucket, r.event_type_id): (r.total_count, r.unique_users)
           for r in spark.read.parquet(out).collect()}
    batch = metrics.hourly_summary(spark.createDataFrame(rows, schemas.EVENTS), _types(spark),
                                   None, None)
    want = {(r.hour_bucket, r.event_type_id): (r.total_count, r.unique_users)
            for r in batch.collect()}
    assert got, "some hours are behind the watermark and must be emitted"
    assert all(want[k] == v for k, v in got.items())
    last = max(r[4] for r in rows) - dt.timedelta(days=1)
    assert all(k[0] + dt.timedelta(hours=1) <= last for k in got)


def test_stream_ingest_ids_continue_across_batches(spark, tmp_path):
    from evtide.session import scratch_path
    users = spark.createDataFrame([(i, f"u{i}", T0) for i in (1, 2)], schemas.USERS)
    src = str(tmp_path / "rec")
    for part in range(3):
        spark.createDataFrame([(1, "click", RFC, None), (2, "view", None, None), (9, "click", RFC, None)],
                              schemas.INGEST_RECORD).coalesce(1).write.mode("append").json(src)
    acc, rej = scratch_path(spark, "acc"), scratch_path(spark, "rej")

    def run():
        streams.ingest_stream(streams.json_records(spark, src, max_files=1), lambda: users,
                              lambda: _types(spark), acc, rej, name=f"ing-{RUN}", as_of=T0,
                              base_id=100, available_now=True).awaitTermination()
    run()
    rows = streams.read_batches(spark, acc, schemas.EVENTS).collect()
    assert sorted(r.id for r in rows) == list(range(101, 107))
    assert {r.timestamp for r in rows} == {T0}
    assert spark.read.parquet(rej).count() == 3
    # a user added while the stream is down, or up, is known to the next batch
    users = users.union(spark.createDataFrame([(9, "u9", T0)], schemas.USERS))
    spark.createDataFrame([(9, "click", RFC, None), (9, "view", "yesterday", None)],
                          schemas.INGEST_RECORD).coalesce(1).write.mode("append").json(src)
    run()
    assert streams.read_batches(spark, acc, schemas.EVENTS).agg(F.max("id")).first()[0] == 107
    assert sorted(r.reason for r in spark.read.parquet(rej).collect()) == [
        "invalid_timestamp", "unknown_user", "unknown_user", "unknown_user"]
    # closed batches move into the day table once, also if a run is repeated
    table = scratch_path(spark, "days")
    assert streams.compact_batches(spark, acc, table, 1) == 2
    assert streams.compact_batches(spark, acc, table, 99) == 2
    assert streams.compact_batches(spark, acc, table, 99) == 0
    assert sorted(r.id for r in sinks.read_events(spark, table).collect()) == list(
        range(101, 108))


def test_dedup_puts_late_rows_aside(spark, tmp_path):
    day = dt.timedelta(days=1)
    src, out, late = (str(tmp_path / n) for n in ("src", "out", "late"))
    files = [[(1, 1, 1, None, T0), (2, 1, 1, None, T0), (1, 1, 1, None, T0)],
             [(2, 1, 1, None, T0), (3, 1, 1, None, T0 + 5 * day)],
             [(4, 1, 1, None, T0), (1, 1, 1, None, T0), (3, 1, 1, None, T0 + 5 * day)]]
    for rows in files:
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
        for query in streams.dedup_replays(stream, out, late, f"dedup-{RUN}", 86400,
                                           available_now=True):
            query.awaitTermination()
    kept = streams.read_batches(spark, out, schemas.EVENTS)
    aside = streams.read_batches(spark, late, schemas.EVENTS)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    # what the watermark may have dropped, and more: rows as old as it in its batch
    assert sorted(r.id for r in aside.collect()) == [1, 2, 4]
    assert sorted(r.id for r in streams.admit_late(kept, aside).collect()) == [1, 2, 3, 4]


def test_dedup_reads_a_constant_number_of_rows_a_batch(spark, tmp_path):
    src, out, late = (str(tmp_path / n) for n in ("src", "out", "late"))
    n = 16
    for k in range(n):          # each file repeats half of the one before
        rows = [(i, 1, 1, None, T0 + dt.timedelta(hours=i)) for i in range(10 * k, 10 * k + 20)]
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
    queries = streams.dedup_replays(stream, out, late, f"const-{RUN}", 40 * 3600,
                                    available_now=True)
    for query in queries:
        query.awaitTermination()
        read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        assert len(read) == n and max(read) <= 2 * 20       # foreachBatch counts a scan each
    held = [p["stateOperators"][0]["numRowsTotal"] for p in queries[0].recentProgress
            if p["stateOperators"]]
    # an id stays for twice the delay, not for good
    assert max(held) <= 100 < 10 * (n + 1) and "rocksdb" in str(queries[0].recentProgress[-1]["stateOperators"])
    kept = streams.admit_late(streams.read_batches(spark, out, schemas.EVENTS),
                              streams.read_batches(spark, late, schemas.EVENTS))
    assert sorted(r.id for r in kept.collect()) == list(range(10 * (n - 1) + 20))


def test_a_log_is_followed_by_position(spark):
    import time
    from evtide.session import scratch_path
    log = spark.createDataFrame([(i // 2, {"k": str(i)}) for i in range(25)],
                                "id long, fields map<string,string>")
    base, name = scratch_path(spark, "log"), f"follow-{RUN}"
    streams.store_log(log, base, 4)
    calls = {}

    def handle(entries, batch_id):
        got = [int(r.fields["k"]) for r in entries.collect()]
        if batch_id == 1 and 1 not in calls:
            calls[1] = got
            raise RuntimeError("the handler fails after it was called")
        assert calls.get(batch_id, got) == got          # a replay gets the same entries
        calls[batch_id] = got

    def until(n):
        query = streams.follow_log(spark, base, name, handle, count=7)
        for _ in range(240):
            if sum(map(len, calls.values())) >= n or not query.isActive:
                break
            time.sleep(0.25)
        query.stop()
    until(25)                                           # ends with the failure
    until(14)
    streams.log_trim_in_place(spark, base, 20)          # of entries that are read already
    until(25)
    order = [k for b in sorted(calls) for k in calls[b]]
    assert sorted(order) == list(range(25))
    assert [k // 2 for k in order] == sorted(k // 2 for k in order)
    assert max(map(len, calls.values())) == 7


def test_failed_refresh_keeps_ticking(spark, tmp_path):
    calls = []

    def broken():
        calls.append(1)
        raise RuntimeError("source unavailable")

    q = streams.scheduled_refresh(spark, broken, lambda: _types(spark),
                                  str(tmp_path / "rollup"), every="1 second",
                                  name=f"broken-{RUN}", skip_first=False)
    for _ in range(240):
        if len(calls) >= 2:
            break
        time.sleep(0.25)
    assert q.isActive and len(calls) >= 2
    q.stop()


def test_deep_pages_and_trims_use_positions(spark):
    from evtide.operators import reads
    e = _events(spark, 60)
    full = [r.id for r in e.orderBy(F.col("timestamp").desc(), F.col("id").desc()).collect()]
    shallow = [r.id for r in reads.events_page(e, limit=7, offset=11).collect()]
    deep = [r.id for r in reads.events_page(e, limit=7, offset=11, deep=True).collect()]
    tail = [r.id for r in reads.events_page(e, offset=50).collect()]
    assert shallow == deep == full[11:18]
    assert tail == full[50:]
    log = streams.log_from_events(e)
    kept = sorted(r.id for r in streams.log_trim(log, 10).collect())
    assert kept == list(range(50, 60))
    approx = streams.log_trim_approx(log, 10).count()
    assert 8 <= approx <= 14
    twice = spark.createDataFrame([(5, {"f": "a"}), (5, {"f": "b"}), (4, {"f": "c"})],
                                  schemas.LOG)
    kept = [(r.id, r.fields["f"]) for r in streams.log_trim(twice, 2).collect()]
    assert sorted(kept) == [(5, "a"), (5, "b")]
    assert [(r.id, r.fields["f"]) for r in streams.log_trim(twice, 1).collect()] == [(5, "b")]


def test_rfc3339_text(spark):
    from evtide.functions.timefn import rfc3339, utc_from_rfc3339
    cases = {"2024-01-10T06:30:00Z": dt.datetime(2024, 1, 10, 6, 30),
             "2024-01-10t06:30:00.5z": dt.datetime(2024, 1, 10, 6, 30, 0, 500000),
             "2024-01-10 06:30:00+03:00": dt.datetime(2024, 1, 10, 3, 30),
             "2024-01-10T06:30:00.123456789-00:30": dt.datetime(2024, 1, 10, 7, 0, 0, 123456),
             "2024-01-10T06:30:00": None, "garbage": None, "": None, "2024-01-10": None,
             "2024-13-10T06:30:00Z": None, "2024-01-10T25:30:00Z": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.u for r in df.select("t", utc_from_rfc3339("t").alias("u")).collect()}
    assert got == cases
    out = spark.createDataFrame(
        [(dt.datetime(2024, 1, 10, 6, 30),), (dt.datetime(2024, 1, 10, 6, 30, 0, 5000),),
         (dt.datetime(2024, 1, 10, 6, 30, 0, 7),)], "t timestamp_ntz").select(rfc3339("t"))
    assert [r[0] for r in out.collect()] == [
        "2024-01-10T06:30:00+00:00", "2024-01-10T06:30:00.005+00:00",
        "2024-01-10T06:30:00.000007+00:00"]


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from evtide import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context,
                           conf=SimpleNamespace(get=lambda name, default=None: default))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(fake)


def _driver_dir(spark, tmp_path, rows):
    """A folder with the driver's events (event_id, user_id, event_type, ts, props)."""
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, "
                          "ts timestamp_ntz, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(1, "c")], "c_custkey long, c_name string").write.parquet(
        f"{d}/customer.parquet")
    return d


def test_log_stream_read_reads_the_whole_log(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace
    from evtide.plans import q_streams
    # looks a thousand times faster at the clock: no number of looks ends the reading
    monkeypatch.setattr(q_streams, "time", SimpleNamespace(sleep=lambda s: time.sleep(0.001)))
    # entries that are alike lie on both sides of the ends of the first and second call
    ids = [*range(3985), *[3990] * 30, *range(4020, 7990), *[8000] * 50, *range(8001, 8300)]
    rows = [(i, 5 if i % 9 else None, "click", T0, '{"k": 1}') for i in ids]
    rows += [(None, 7, "view", T0, '{"k": 1}')] * 3
    d = _driver_dir(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in q_streams.q_log_stream_read(spark, d).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k in range(0, len(ordered), 4000):
        part = ordered[k:k + 4000]
        known = [r[0] for r in part if r[0] is not None]
        want.append((k // 4000, min(known), max(known), len(part), sum(r[1] or 0 for r in part)))
    assert got == want and sum(r[3] for r in got) == len(rows) > 8000


def test_log_stream_read_of_no_events_or_a_failed_consumer(spark, tmp_path, monkeypatch):
    from evtide.plans import q_streams
    assert q_streams.q_log_stream_read(
        spark, _driver_dir(spark, tmp_path / "none", [])).collect() == []
    d = _driver_dir(spark, tmp_path, [(1, 1, "click", T0, '{"k": 1}')])

    def broken(*_):
        raise ValueError("the entries cannot be read")
    monkeypatch.setattr(streams.ranges, "between", broken)
    with pytest.raises(RuntimeError, match="0 of 1 calls"):
        q_streams.q_log_stream_read(spark, d)


def test_entries_that_are_alike_are_all_read(spark):
    from evtide.session import scratch_path
    log = spark.createDataFrame([(i // 20, {"k": "same"}) for i in range(50)],
                                "id long, fields map<string,string>")
    base, name, calls = scratch_path(spark, "log"), f"alike-{RUN}", {}
    streams.store_log(log, base, 4)
    # a consumer begun on the clock of one row a second goes on with it
    begun = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = streams.consume(begun, name, lambda b, i: None, available_now=True)
    q.awaitTermination()

    def handle(entries, batch_id):
        assert entries.columns == ["id", "fields"]
        calls[batch_id] = [r.id for r in entries.collect()]
    query = streams.follow_log(spark, base, name, handle, count=7)
    for _ in range(240):
        if sum(map(len, calls.values())) >= 50 or not query.isActive:
            break
        time.sleep(0.25)
    query.stop()
    assert [i for b in sorted(calls) for i in calls[b]] == [i // 20 for i in range(50)]
    assert [len(calls[b]) for b in sorted(calls)] == [7] * 7 + [1]
