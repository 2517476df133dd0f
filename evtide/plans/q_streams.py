"""Streaming forms run to completion on file streams, and log operations."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from evtide.operators import mutations, reads
from evtide.plans.oracle import sql, tsl
from evtide.plans.q_mutations import (
    RFC3339_SQL, ingest_records, rfc3339_records, INGEST_SQL,
)
from evtide.plans.q_report import ROLLUP_SQL
from evtide.plans.registry import AS_OF, ORACLES, register, _t
from evtide.session import file_state, scratch_path
from evtide.sources import ranges, schemas, sinks
from evtide.sources.driver_tables import read_driver
from evtide.streaming import streams


def _named(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _events_as_files(spark, sf_dir, copies: int = 1, files: int = 4) -> str:
    """Write the canonical events as Parquet files for a file-stream source."""
    path = scratch_path(spark, "events-src")
    ev = _t(spark, sf_dir).events
    for _ in range(copies):
        ev.repartition(files).write.mode("append").parquet(path)
    return path


@register("stream_dedup", sql("SELECT * FROM c_events"))
def q_stream_dedup(spark, sf_dir):
    """Every event delivered twice, in no order; the state store keeps one copy
    per id, events a day late are put aside and admitted afterwards (T7)."""
    src = _events_as_files(spark, sf_dir, copies=2)
    out, late = scratch_path(spark, "stream-dedup"), scratch_path(spark, "stream-late")
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=2)
    for query in streams.dedup_replays(stream, out, late, _named(out), 86_400,
                                       available_now=True):
        query.awaitTermination()
    return streams.admit_late(streams.read_batches(spark, out, schemas.EVENTS),
                              streams.read_batches(spark, late, schemas.EVENTS))


def _stream_ingest(spark, sf_dir, records):
    src = scratch_path(spark, "ingest-src")
    records.repartition(3).write.json(src)
    acc, rej = scratch_path(spark, "accepted"), scratch_path(spark, "rejects")
    t = _t(spark, sf_dir)
    streams.ingest_stream(streams.json_records(spark, src, max_files=1), lambda: t.users,
                          lambda: t.event_types, acc, rej, name=_named(acc), as_of=AS_OF,
                          base_id=mutations.max_id(t.events), available_now=True
                          ).awaitTermination()
    return acc, rej


@register("stream_ingest", sql(f"""
SELECT user_id, type_id AS event_type_id, metadata,
       coalesce("timestamp", {tsl(AS_OF)}) AS "timestamp"
FROM chk WHERE reason IS NULL""", INGEST_SQL))
def q_stream_ingest(spark, sf_dir):
    """JSON ingest records through the streaming ingest (T1), the accepted
    batches compacted into a day-partitioned table."""
    recs = ingest_records(spark, sf_dir).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    acc, _ = _stream_ingest(spark, sf_dir, recs)
    table = scratch_path(spark, "events-by-day")
    streams.compact_batches(spark, acc, table, 10 ** 9)
    return sinks.read_events(spark, table).drop("id")


@register("stream_ingest_rfc3339", sql(f"""
SELECT user_id, event_type_id, metadata, coalesce(utc, {tsl(AS_OF)}) AS "timestamp",
       CAST(NULL AS VARCHAR) AS reason FROM rfc WHERE reason IS NULL
UNION ALL
SELECT user_id, NULL, metadata, NULL, reason FROM rfc WHERE reason IS NOT NULL""", RFC3339_SQL))
def q_stream_ingest_rfc3339(spark, sf_dir):
    """Streamed JSON records with zoned, fractional, absent and bad times (T1,
    S10): accepted events and reject reasons."""
    acc, rej = _stream_ingest(spark, sf_dir, rfc3339_records(spark, sf_dir))
    good = streams.read_batches(spark, acc, schemas.EVENTS).select(
        "user_id", "event_type_id", "metadata", "timestamp",
        F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(rej).select(
        "user_id", F.lit(None).cast("int").alias("event_type_id"), "metadata",
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), "reason")
    return good.unionByName(bad)


@register("scheduled_refresh", sql("SELECT * FROM rollup", ROLLUP_SQL))
def q_scheduled_refresh(spark, sf_dir):
    """The timed rebuild (T2): the clock ticks without any new event; the
    first tick is skipped, a later one writes the snapshot that is read back."""
    t = _t(spark, sf_dir)
    base = scratch_path(spark, "scheduled-rollup")
    q = streams.scheduled_refresh(spark, lambda: t.hot, lambda: t.event_types, base,
                                  every="1 second", name=_named(base), as_of=AS_OF)
    try:
        for _ in range(600):
            if sinks.versions(spark, base) or not q.isActive:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    return sinks.read_current(spark, base, schemas.ROLLUP)


@register("log_consumers", sql("""
SELECT 'counts' AS consumer, event_type_id, count(*) AS n FROM c_events GROUP BY 2
UNION ALL SELECT 'users', event_type_id, count(DISTINCT user_id) FROM c_events GROUP BY 2"""))
def q_log_consumers(spark, sf_dir):
    """Two independent consumers of one log (T10), each with its own position:
    one counts entries, one collects the users it has seen."""
    src = _events_as_files(spark, sf_dir)
    outs = {}
    for who in ("counts", "users"):
        out = outs[who] = scratch_path(spark, f"consumer-{who}")

        def handle(batch, batch_id, who=who, out=out):
            g = batch.groupBy("event_type_id").agg(F.count(F.lit(1)).alias("n"))
            d = g if who == "counts" else batch.select("event_type_id", "user_id").distinct()
            d.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        source = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
        streams.consume(source, _named(out), handle, available_now=True).awaitTermination()
    counts = spark.read.parquet(outs["counts"]).groupBy("event_type_id").agg(
        F.sum("n").alias("n"))
    users = spark.read.parquet(outs["users"]).groupBy("event_type_id").agg(
        F.countDistinct("user_id").alias("n"))
    return counts.withColumn("consumer", F.lit("counts")).unionByName(
        users.withColumn("consumer", F.lit("users")))


SESSION_SQL = """
g AS (
  SELECT user_id, "timestamp",
    CASE WHEN lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp") IS NULL
           OR "timestamp" - lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp")
              >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_session
  FROM c_events),
s AS (
  SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY "timestamp"
                                   ROWS UNBOUNDED PRECEDING) AS sid FROM g)"""


@register("inactivity_sessions", sql("""
SELECT user_id, min("timestamp") AS session_start,
       max("timestamp") + INTERVAL 30 MINUTE AS session_end, count(*) AS events
FROM s GROUP BY user_id, sid""", SESSION_SQL))
def q_inactivity_sessions(spark, sf_dir):
    """Sessions split by 30 minutes of inactivity (T6, batch form)."""
    return streams.inactivity_sessions(_t(spark, sf_dir).events, "30 minutes")


@register("log_range", sql("""
SELECT id, CAST(user_id AS VARCHAR) AS user_id FROM c_events
WHERE id BETWEEN 100 AND 5000 ORDER BY id DESC LIMIT 20"""))
def q_log_range(spark, sf_dir):
    log = streams.log_from_events(_t(spark, sf_dir).events)
    return streams.log_range(log, 100, 5000, count=20, reverse=True).select(
        "id", F.col("fields")["user_id"].alias("user_id"))


@register("log_read_after", sql(
    "SELECT id, CAST(event_type_id AS VARCHAR) AS event_type_id FROM c_events "
    "WHERE id > 4321 ORDER BY id LIMIT 10"))
def q_log_read_after(spark, sf_dir):
    log = streams.log_from_events(_t(spark, sf_dir).events)
    return streams.log_read_after(log, 4321, 10).select(
        "id", F.col("fields")["event_type_id"].alias("event_type_id"))


@register("log_trim", sql("""
SELECT count(*) AS length, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT id FROM c_events ORDER BY id DESC LIMIT 1000) x"""))
def q_log_trim(spark, sf_dir):
    log = streams.log_from_events(_t(spark, sf_dir).events)
    return streams.log_info(streams.log_trim(log, 1000)).select("length", "first_id", "last_id")


@register("log_trim_repeats", sql("""
SELECT id, user_id FROM (
  SELECT o_custkey AS id, o_orderkey AS user_id, row_number() OVER (
    ORDER BY o_custkey DESC, '{"order":"' || CAST(o_orderkey AS VARCHAR) || '"}' DESC) AS k
  FROM orders) x WHERE k <= 777"""))
def q_log_trim_repeats(spark, sf_dir):
    """Exact trim (T11) of a log whose ids repeat, at the cut too."""
    log = read_driver(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.create_map(F.lit("order"), F.col("o_orderkey").cast("string")).alias("fields"))
    return streams.log_trim(log, 777).select(
        "id", F.col("fields")["order"].cast("long").alias("user_id"))


@register("log_trim_approx", sql("""
SELECT TRUE AS enough, TRUE AS close, max(id) AS last_id FROM c_events"""))
def q_log_trim_approx(spark, sf_dir):
    """The approximate trim (T11): at least as many as asked for, one in a hundred
    more at most, and the newest of all."""
    log = streams.log_from_events(_t(spark, sf_dir).events)
    n = F.count(F.lit(1))
    return streams.log_trim_approx(log, 500).agg(
        (n >= 500).alias("enough"), (n <= 505).alias("close"), F.max("id").alias("last_id"))


@register("log_trim_in_place", sql("""
SELECT id, user_id FROM (
  SELECT o_custkey AS id, o_orderkey AS user_id, row_number() OVER (
    ORDER BY o_custkey DESC, '{"order":"' || CAST(o_orderkey AS VARCHAR) || '"}' DESC) AS k
  FROM orders) x WHERE k <= 555"""))
def q_log_trim_in_place(spark, sf_dir):
    """A stored log trimmed twice where it lies (T11), its ids repeat."""
    base = scratch_path(spark, "log")
    log = read_driver(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.create_map(F.lit("order"), F.col("o_orderkey").cast("string")).alias("fields"))
    streams.store_log(log, base)
    for n in (777, 555):
        streams.log_trim_in_place(spark, base, n)
    return ranges.data(spark, base).select(
        "id", F.col("fields")["order"].cast("long").alias("user_id"))


@register("log_stream_read", sql("""
SELECT (k - 1) // 4000 AS call, min(id) AS first_id, max(id) AS last_id, count(*) AS n,
       CAST(sum(user_id) AS BIGINT) AS users
FROM (SELECT id, user_id, row_number() OVER (ORDER BY id) AS k FROM c_events) x GROUP BY 1"""))
def q_log_stream_read(spark, sf_dir):
    """A consumer that reads a stored log by position (T9), 4000 entries a call, is
    stopped after the first ones and goes on."""
    base, out = scratch_path(spark, "log"), scratch_path(spark, "log-calls")
    streams.store_log(streams.log_from_events(_t(spark, sf_dir).events), base)
    size = ranges.index(spark, base).agg(F.max("total")).first()[0] or 0
    calls = set()

    def handle(entries, batch_id):
        entries.select("id", F.col("fields")["user_id"].cast("long").alias("user_id")) \
            .write.mode("overwrite").parquet(f"{out}/call={batch_id}")
        calls.add(batch_id)

    whole = -(-size // 4000)
    for wanted in (min(1, whole), whole):
        query = streams.follow_log(spark, base, _named(out), handle, count=4000)
        try:
            # however long it takes: the log is read to its end, or the query fails
            while len(calls) < wanted and query.isActive:
                time.sleep(0.05)
            if len(calls) < wanted:
                raise RuntimeError(f"the log was read by {len(calls)} of {whole} calls"
                                   ) from query.exception()
        finally:
            query.stop()
    # batches that found nothing have no folder: calls are numbered as they came
    order = {b: k for k, b in enumerate(sorted(calls))}
    numbers = spark.createDataFrame(list(order.items()), "batch long, k long")
    schema = "id long, user_id long, call long"
    return ((spark.read.schema(schema).parquet(out) if calls else spark.createDataFrame([], schema))
            .groupBy(F.col("call").alias("batch")).agg(
                F.min("id").alias("first_id"), F.max("id").alias("last_id"),
                F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
            .join(numbers, "batch").select(F.col("k").alias("call"), "first_id", "last_id", "n",
                                           "users"))


@register("log_info", sql("""
SELECT count(*) AS length, min(id) AS first_id, max(id) AS last_id,
       CAST(arg_min(user_id, id) AS VARCHAR) AS first_user,
       CAST(arg_max(user_id, id) AS VARCHAR) AS last_user FROM c_events"""))
def q_log_info(spark, sf_dir):
    """Length, first and last entry with a field of each."""
    return streams.log_info(streams.log_from_events(_t(spark, sf_dir).events)).select(
        "length", "first_id", "last_id", F.col("first_fields")["user_id"].alias("first_user"),
        F.col("last_fields")["user_id"].alias("last_user"))


@register("log_delete", sql(
    "SELECT id FROM c_events WHERE id NOT IN (SELECT o_orderkey FROM orders "
    "WHERE o_orderstatus = 'P')"))
def q_log_delete(spark, sf_dir):
    """Delete log entries by id."""
    log = streams.log_from_events(_t(spark, sf_dir).events)
    ids = read_driver(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("id"))
    return streams.log_delete(log, ids).select("id")


def _events_in_time_order(spark, sf_dir, slices: int = 4) -> tuple[str, int, int]:
    """Write the canonical events as ``slices`` time ranges, oldest first, and a
    marker event (user -1, type 0) a year after the data, which moves the
    watermark past every real window and session; its own stay open, so it is
    never output. Files of one range arrive in any order: returns the folder,
    the longest range in seconds, the delay that the watermark must allow, and the
    most files of a range."""
    path = scratch_path(spark, "events-ordered")
    ev = _t(spark, sf_dir).events
    secs = F.unix_micros(F.col("timestamp").cast("timestamp"))
    span = ev.agg(F.min(secs).alias("a"), F.max(secs).alias("b")).first()
    step = (span.b - span.a) // slices + 1 if span.a is not None else 1
    written = [0]
    for k in range(slices if span.a is not None else 0):
        lo = span.a + k * step
        ev.filter((secs >= F.lit(lo)) & (secs < F.lit(lo + step))).write.mode("append").parquet(
            path)
        written.append(sum(f[0].endswith(".parquet") for f in file_state(spark, path)))
    (ev.agg(F.max("timestamp").alias("m"))
     .select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("user_id"),
             F.lit(0).alias("event_type_id"), F.lit('{"page":"end"}').alias("metadata"),
             (F.col("m") + F.expr("INTERVAL 365 DAYS")).alias("timestamp"))
     .write.mode("append").parquet(path))
    most = max((b - a for a, b in zip(written, written[1:])), default=0)
    return path, step // 1_000_000 + 1, most


def _run_ordered(spark, sf_dir, make, name: str):
    """``make(stream, watermark)`` run to completion in append mode. A batch takes
    as many files as a time range has: each one starts, commits and checks every
    state partition, so their number must not grow with the files."""
    src, delay, files = _events_in_time_order(spark, sf_dir)
    out = scratch_path(spark, name)
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=max(2, files))
    streams.append_stream(make(stream, f"{delay} seconds"), out, _named(out),
                          available_now=True).awaitTermination()
    return spark.read.parquet(out)


@register("stream_sessions", ORACLES["inactivity_sessions"])
def q_stream_sessions(spark, sf_dir):
    """Live sessions by 30 minutes of inactivity (T6) on a stream that
    arrives in time order, append mode."""
    return _run_ordered(spark, sf_dir, lambda s, w: streams.inactivity_sessions(
        s, "30 minutes", watermark=w), "stream-sessions")


@register("stream_rollup", sql("""
SELECT t.name AS event_type, date_trunc('hour', e."timestamp") AS hour_bucket,
       count(*) AS total_count, count(DISTINCT e.user_id) AS unique_users
FROM c_events e JOIN c_event_types t ON e.event_type_id = t.id GROUP BY 1, 2"""))
def q_stream_rollup(spark, sf_dir):
    """Incremental hourly rollup (T4): per-(hour, type, user) state, then per
    (hour, type), every hour output once."""
    rows = _run_ordered(spark, sf_dir, streams.windowed_type_counts, "stream-rollup")
    return reads.with_type_name(rows, _t(spark, sf_dir).event_types).select(
        "event_type", F.col("window_start").alias("hour_bucket"), "total_count", "unique_users")


@register("stream_rollup_pages", sql("""
SELECT coalesce(json_extract_string(metadata, '$.page'), 'unknown') AS page,
       date_trunc('hour', "timestamp") AS hour_bucket, count(*) AS page_count
FROM c_events WHERE list_contains(json_keys(metadata), 'page') GROUP BY 1, 2"""))
def q_stream_rollup_pages(spark, sf_dir):
    """Page half of the incremental rollup (T4 for A7)."""
    rows = _run_ordered(spark, sf_dir, streams.windowed_page_counts, "stream-pages")
    return rows.select("page", F.col("window_start").alias("hour_bucket"), "page_count")


_SLIDING = """(
  SELECT time_bucket(INTERVAL 30 MINUTE, "timestamp") - k * INTERVAL 30 MINUTE AS ws,
         user_id, event_type_id
  FROM c_events, (VALUES (0), (1)) v(k)) w"""


@register("stream_live_metrics", sql(f"""
SELECT w.ws AS window_start, t.name AS event_type, count(*) AS total_count,
       count(DISTINCT w.user_id) AS unique_users
FROM {_SLIDING} JOIN c_event_types t ON w.event_type_id = t.id GROUP BY 1, 2"""))
def q_stream_live_metrics(spark, sf_dir):
    """Live per-type metrics on sliding windows (T5): one hour every 30 minutes."""
    rows = _run_ordered(spark, sf_dir, lambda s, w: streams.windowed_type_counts(
        s, w, "1 hour", "30 minutes"), "stream-live")
    return reads.with_type_name(rows, _t(spark, sf_dir).event_types).select(
        "window_start", "event_type", "total_count", "unique_users")


@register("stream_live_totals", sql(f"""
SELECT ws AS window_start, count(*) AS total_events, count(DISTINCT user_id) AS unique_users
FROM {_SLIDING} GROUP BY 1"""))
def q_stream_live_totals(spark, sf_dir):
    """Events and distinct users of every sliding window, all types (T5)."""
    return _run_ordered(spark, sf_dir, lambda s, w: streams.windowed_totals(
        s, w, "1 hour", "30 minutes"), "stream-totals")


@register("stream_rollup_bounded", ORACLES["stream_rollup"])
def q_stream_rollup_bounded(spark, sf_dir):
    """The incremental rollup (T4) under its earlier name."""
    return q_stream_rollup(spark, sf_dir)
