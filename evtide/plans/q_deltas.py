"""The rollup kept by signed changes through a chain of table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtide.functions.timefn import lookback_start
from evtide.operators import deltas, mutations
from evtide.plans.oracle import sql, tsl
from evtide.plans.q_mutations import (
    INGEST_SQL, UPDATE_SQL, _fulfilled, event_updates, ingest_records,
)
from evtide.plans.q_report import ROLLUP_SQL
from evtide.plans.q_streams import _events_as_files, _named
from evtide.plans.registry import AS_OF, register, _t
from evtide.session import scratch_path
from evtide.sources import schemas, sinks
from evtide.sources.driver_tables import stored_snapshot
from evtide.streaming import streams

# Both fall within an hour, so neither end of the kept range is a whole hour.
CUTOFF = "2024-01-12 12:30:00"
LATER = "2024-02-14 18:20:00"

_UPDATED = UPDATE_SQL.replace("chk", "judged")
# The events after updates, deletes, ingest and retention, one after another.
CHANGED_SQL = f"""{_UPDATED},{INGEST_SQL},
updated AS (
  SELECT e.id, e.user_id, coalesce(g.event_type_id, e.event_type_id) AS event_type_id,
         coalesce(g.metadata, e.metadata) AS metadata, e."timestamp"
  FROM c_events e LEFT JOIN judged g ON g.event_id = e.id AND g.status = 'updated'),
now_events AS (
  SELECT user_id, event_type_id, metadata, "timestamp" FROM (
    SELECT * FROM updated
    WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT NULL, user_id, type_id, metadata, coalesce("timestamp", {tsl(AS_OF)})
    FROM chk WHERE reason IS NULL)
  WHERE "timestamp" >= {tsl(CUTOFF)})"""


def _change(t, base: str, spark, sf_dir) -> None:
    """Take a day-partitioned events table and its rollup (in ``base``) through an
    update, a delete, an ingest (with events of today and of long ago) and
    retention, the rollup by changes alone."""
    path, since = f"{base}/events", lookback_start(AS_OF)
    sinks.append_events(t.hot, path)
    deltas.record(deltas.changes(t.hot), base, since=since)
    deltas.apply(spark, base)

    updates = event_updates(spark, sf_dir)
    ids = updates.select(F.col("event_id").alias("id"))
    after = mutations.update_events(t.events, updates, t.event_types).table
    deltas.record(deltas.update_changes(t.events, after, ids), base, since=since)
    mutations.update_events_in_place(path, updates, t.event_types)

    gone = _fulfilled(spark, sf_dir)
    deltas.record(deltas.delete_changes(sinks.read_events(spark, path), gone), base, since=since)
    mutations.delete_events_in_place(path, gone)
    deltas.apply(spark, base)           # two batches at once

    new = mutations.ingest_events(ingest_records(spark, sf_dir), t.users, t.event_types,
                                  as_of=AS_OF, events=t.events).table
    sinks.append_events(new.select(*schemas.EVENTS.fieldNames()), path)
    deltas.record(deltas.changes(new), base, since=since)
    deltas.drop_before(spark, base, CUTOFF, sinks.read_events(spark, path))
    mutations.retention_in_place(path, CUTOFF, spark=spark)


def _changed(spark, sf_dir) -> str:
    return stored_snapshot(spark, sf_dir, "delta-rollup",
                           lambda t, base: _change(t, base, spark, sf_dir))


@register("rollup_deltas", sql("SELECT * FROM rollup", CHANGED_SQL + "," + ROLLUP_SQL.replace(
    "c_events", "now_events")))
def q_rollup_deltas(spark, sf_dir):
    """The rollup after updates, deletes, ingest and retention, from changes."""
    return deltas.current(spark, _changed(spark, sf_dir), _t(spark, sf_dir).event_types, as_of=AS_OF)


@register("rollup_deltas_later", sql("SELECT * FROM rollup", CHANGED_SQL + "," + (
    ROLLUP_SQL.replace("c_events", "now_events").replace(tsl(AS_OF), tsl(LATER)))))
def q_rollup_deltas_later(spark, sf_dir):
    """The same some days later: the lookback begins within an hour, which is
    the one hour counted from the events."""
    base = _changed(spark, sf_dir)
    return deltas.current(spark, base, _t(spark, sf_dir).event_types, as_of=LATER,
                          events=sinks.read_events(spark, f"{base}/events"))


@register("stream_rollup_deltas", sql("SELECT * FROM rollup", ROLLUP_SQL))
def q_stream_rollup_deltas(spark, sf_dir):
    """The rollup of a stream whose events come in no order at all."""
    src = _events_as_files(spark, sf_dir, files=3)
    base = scratch_path(spark, "delta-rollup")
    stream = streams.parquet_stream(spark, src, schemas.EVENTS, max_files=1)
    streams.delta_rollup(stream, base, _named(base), available_now=True).awaitTermination()
    return deltas.current(spark, base, _t(spark, sf_dir).event_types, as_of=AS_OF)
