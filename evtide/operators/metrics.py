"""Direct metrics over the events table.

Aggregations group on integer ids first and join the (small) dimension to the
aggregated rows afterwards, so the fact table is never joined row by row when
only counts are needed. Distinct counts use Spark's two-level distinct
aggregation (partial on (group, user), then per group), which pre-aggregates
map-side even when one group holds a large share of the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtide.functions.metadata import with_hot_columns
from evtide.functions.timefn import parse_ts, trunc, ts, utcnow
from evtide.operators.joins import restrict_type, with_type_name
from evtide.operators.keyed import ordered_positions
from evtide.operators.reads import in_range

BUCKETS = {"minute": "minute", "hour": "hour", "day": "day"}
PERIODS = {"daily": 1, "weekly": 7, "monthly": 30}


def _bucket(bucket: str) -> str:
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {sorted(BUCKETS)}")
    return BUCKETS[bucket]


def _distinct(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.countDistinct(col)


# ---------------------------------------------------------------- A1-A5
def count_rows(df: DataFrame) -> DataFrame:
    """Row count of any table (A1)."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_events(events: DataFrame, event_types: DataFrame, frm, to,
                 event_type: str | None = None) -> DataFrame:
    """Events in the closed range, optional type (A2)."""
    ev = restrict_type(in_range(events, frm, to), event_types, event_type)
    return ev.agg(F.count(F.lit(1)).alias("count"))


def unique_users(events: DataFrame, event_types: DataFrame, frm, to,
                 event_type: str | None = None, approx: bool = False) -> DataFrame:
    """Exact (or approximate) distinct users in the closed range (A3)."""
    ev = restrict_type(in_range(events, frm, to), event_types, event_type)
    return ev.agg(_distinct("user_id", approx).alias("unique_users"))


def event_type_stats(events: DataFrame, event_types: DataFrame, frm, to,
                     event_type: str | None = None) -> DataFrame:
    """Count per type in range, most first, name breaks ties (A4)."""
    ev = restrict_type(in_range(events, frm, to), event_types, event_type)
    per_id = ev.groupBy("event_type_id").agg(F.count(F.lit(1)).alias("count"))
    return (with_type_name(per_id, event_types)
            .select("event_type", "count")
            .orderBy(F.col("count").desc(), F.col("event_type")))


def top_pages(events: DataFrame, event_types: DataFrame, frm, to,
              event_type: str | None = None, limit: int = 10) -> DataFrame:
    """Top pages in range among rows that have a ``page`` key (A5).

    Groups on the raw extracted text (a JSON-null page is its own group) and
    shows it as ``unknown``; ties break on the shown page. Reads the columns
    extracted at ingest.
    """
    ev = with_hot_columns(restrict_type(in_range(events, frm, to), event_types, event_type))
    ev = ev.filter(F.col("m_has_page"))
    per = ev.groupBy(F.col("m_page_text").alias("_raw")).agg(
        F.count(F.lit(1)).alias("count"))
    shown = F.coalesce(F.col("_raw"), F.lit("unknown"))
    return (per.orderBy(F.col("count").desc(), shown, F.col("_raw").asc_nulls_first())
            .limit(max(int(limit), 0))
            .select(shown.alias("page"), "count"))


# ---------------------------------------------------------------- A14-A16
def realtime_metrics(events: DataFrame, event_types: DataFrame, bucket: str = "minute",
                     at=None, event_type: str | None = None,
                     user_ids: list[int] | None = None) -> DataFrame:
    """Metrics of the one bucket containing ``at``.

    One row per event type in the bucket: (bucket_start, event_type,
    type_count, total_events, unique_users). ``nested_realtime_metrics``
    gives the single-row form with a type -> count map.
    """
    unit = _bucket(bucket)
    at = parse_ts(at) or utcnow()
    start, end = bucket_bounds(unit, at)
    ev = restrict_type(events, event_types, event_type)
    if user_ids is not None:
        ev = ev.filter(F.col("user_id").isin(list(user_ids)))
    # half-open range on the raw column: reaches the Parquet scan
    ev = ev.filter((F.col("timestamp") >= ts(start)) & (F.col("timestamp") < ts(end)))
    return _bucket_metrics(ev, event_types, unit)


def bucket_bounds(unit: str, at: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """[start, end) of the minute / hour / day bucket containing ``at``."""
    if unit == "minute":
        start = at.replace(second=0, microsecond=0)
        return start, start + dt.timedelta(minutes=1)
    if unit == "hour":
        start = at.replace(minute=0, second=0, microsecond=0)
        return start, start + dt.timedelta(hours=1)
    start = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return start, start + dt.timedelta(days=1)


def _bucket_metrics(ev: DataFrame, event_types: DataFrame, unit: str) -> DataFrame:
    # one scan: per-(bucket, type, user) counts, folded by (bucket, type) and by
    # bucket at once; the window then runs over a row per type and bucket
    per_user = ev.groupBy(trunc(unit, "timestamp").alias("bucket_start"), "event_type_id",
                          "user_id").agg(F.count(F.lit(1)).alias("_n"))
    bucket, kind = F.col("bucket_start"), F.col("event_type_id")
    folded = per_user.groupingSets([[bucket, kind], [bucket]], bucket, kind).agg(
        F.grouping("event_type_id").alias("_all"), F.sum("_n").alias("_events"),
        F.countDistinct("user_id").alias("_users"))
    w = Window.partitionBy("bucket_start")
    per = folded.select(
        "bucket_start", "event_type_id", "_all", F.col("_events").alias("type_count"),
        F.max(F.when(F.col("_all") == 1, F.col("_events"))).over(w).alias("total_events"),
        F.max(F.when(F.col("_all") == 1, F.col("_users"))).over(w).alias("unique_users"))
    return with_type_name(per.filter("_all = 0"), event_types).select(
        "bucket_start", "event_type", "type_count", "total_events", "unique_users")


def nested_realtime_metrics(long_form: DataFrame) -> DataFrame:
    """Single-row-per-bucket form: total, distinct users, map type -> count.

    The map gathers one entry per event type of the bucket (the dimension's
    size), never fact rows.
    """
    return long_form.groupBy("bucket_start").agg(
        F.first("total_events").alias("total_events"),
        F.first("unique_users").alias("unique_users"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("event_type", "type_count")))).alias("by_type"))


def timeseries(events: DataFrame, event_types: DataFrame, bucket: str, frm, to,
               event_type: str | None = None, fill_gaps: bool = False) -> DataFrame:
    """A14 for every bucket of the closed range [frm, to].

    (bucket, type) counts and per-bucket distinct users, both folded from one
    aggregate of the events, joined on the bucket. With ``fill_gaps`` every bucket start between
    floor(frm) and floor(to) appears; empty ones carry a null type and zeros.
    """
    unit = _bucket(bucket)
    ev = restrict_type(in_range(events, frm, to), event_types, event_type)
    out = _bucket_metrics(ev, event_types, unit)
    if not fill_gaps:
        return out
    step = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR",
            "day": "INTERVAL 1 DAY"}[unit]
    spark = events.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(
        trunc(unit, ts(parse_ts(frm))), trunc(unit, ts(parse_ts(to))),
        F.expr(step))).alias("bucket_start"))
    # the grid holds (to - from) / bucket rows: a parameter-sized table
    empty = grid.join(out.select("bucket_start").distinct(), "bucket_start", "left_anti")
    zeros = empty.select("bucket_start", F.lit(None).cast("string").alias("event_type"),
                         F.lit(0).cast("long").alias("type_count"),
                         F.lit(0).cast("long").alias("total_events"),
                         F.lit(0).cast("long").alias("unique_users"))
    return out.unionByName(zeros)


def hourly_summary(events: DataFrame, event_types: DataFrame, frm, to,
                   type_ids: list[int] | None = None) -> DataFrame:
    """Hourly count and distinct users per type, optional list of type ids."""
    ev = in_range(events, frm, to)
    if type_ids is not None:
        ev = ev.filter(F.col("event_type_id").isin(list(type_ids)))
    per = ev.groupBy("event_type_id", trunc("hour", "timestamp").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.countDistinct("user_id").alias("unique_users"))
    return with_type_name(per, event_types).select(
        "event_type_id", "event_type", "hour_bucket", "total_count", "unique_users")


# ---------------------------------------------------------------- A17-A19
def user_activity(events: DataFrame, frm=None, to=None,
                  user_id: int | None = None) -> DataFrame:
    """Per user: event count, distinct types, first and last time."""
    ev = in_range(events, frm, to)
    if user_id is not None:
        ev = ev.filter(F.col("user_id") == F.lit(user_id))
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("event_type_id").alias("distinct_types"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def popular_events(events: DataFrame, event_types: DataFrame, period: str = "daily",
                   as_of=None, limit: int = 10) -> DataFrame:
    """Most frequent types over the last day / week / month before ``as_of``
    (closed range), with distinct users and the period's name (A18)."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    end = parse_ts(as_of) or utcnow()
    start = end - dt.timedelta(days=PERIODS[period])
    ev = in_range(events, start, end)
    per = ev.groupBy("event_type_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.countDistinct("user_id").alias("unique_users"))
    return (with_type_name(per, event_types)
            .orderBy(F.col("count").desc(), F.col("event_type"))
            .limit(max(int(limit), 0))
            .select(F.lit(period).alias("period"), "event_type", "count", "unique_users"))


def users_with_metrics(users: DataFrame, events: DataFrame) -> DataFrame:
    """Every user with totals, distinct types and pages, first/last time.

    Users without events are kept with zeros (left join of the aggregate,
    which has one row per active user).
    """
    per = with_hot_columns(events).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("event_type_id").alias("distinct_types"),
        F.countDistinct("m_page").alias("distinct_pages"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))
    j = users.join(per.withColumnRenamed("user_id", "id"), "id", "left")
    return j.select("id", "name", "created_at",
                    F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"),
                    F.coalesce("distinct_types", F.lit(0).cast("long")).alias("distinct_types"),
                    F.coalesce("distinct_pages", F.lit(0).cast("long")).alias("distinct_pages"),
                    "first_seen", "last_seen")


# ---------------------------------------------------------------- A20-A23
# Rows without the key field are filtered before grouping: on stored events the
# field is a column, so the filter reaches the Parquet scan.
def page_analytics(events: DataFrame, frm=None, to=None) -> DataFrame:
    """Per page of the typed metadata: events, distinct users and sessions."""
    ev = with_hot_columns(in_range(events, frm, to)).filter(F.col("m_page").isNotNull())
    return ev.groupBy(F.col("m_page").alias("page")).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("m_session_id").alias("unique_sessions"))


def referrer_host(referrer) -> "F.Column":
    col = F.col(referrer) if isinstance(referrer, str) else referrer
    return F.try_parse_url(col, F.lit("HOST"))


def referrer_analytics(events: DataFrame, by: str = "host", frm=None, to=None) -> DataFrame:
    """Per referrer (``by="referrer"``) or referrer host (A21): events,
    distinct users, distinct sessions."""
    ev = with_hot_columns(in_range(events, frm, to)).filter(F.col("m_referrer").isNotNull())
    key = F.col("m_referrer") if by == "referrer" else referrer_host("m_referrer")
    return ev.groupBy(key.alias(by)).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("m_session_id").alias("unique_sessions"))


def product_analytics(events: DataFrame, event_types: DataFrame, frm=None, to=None
                      ) -> DataFrame:
    """Per (product id, event type): events and distinct users."""
    ev = with_hot_columns(in_range(events, frm, to)).filter(F.col("m_product_id").isNotNull())
    per = ev.groupBy(F.col("m_product_id").alias("product_id"), "event_type_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_id").alias("unique_users"))
    return with_type_name(per, event_types).select(
        "product_id", "event_type", "events", "unique_users")


def product_pivot(events: DataFrame, event_types: DataFrame, type_names: list[str]
                  ) -> DataFrame:
    """Wide form of A22: one count column per listed type name."""
    per = product_analytics(events, event_types)
    return (per.groupBy("product_id").pivot("event_type", list(type_names)).sum("events")
            .na.fill(0, list(type_names)))


def _session_events(events: DataFrame, frm, to) -> DataFrame:
    return with_hot_columns(in_range(events, frm, to)).filter(F.col("m_session_id").isNotNull())


def sessions(events: DataFrame, frm=None, to=None) -> DataFrame:
    """Events grouped by metadata session_id.

    Per session: user, start, end, length in seconds, event count, distinct
    pages, entry and exit page (page of the first / last event by (time, id)).
    Every aggregate is mergeable (min_by/max_by, counts), so a huge session
    never has to be held in one buffer. ``session_pages`` has the pages.
    """
    order = F.struct("timestamp", "id")
    g = _session_events(events, frm, to).groupBy(F.col("m_session_id").alias("session_id")).agg(
        F.min("user_id").alias("user_id"),
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("m_page").alias("distinct_pages"),
        F.min_by("m_page", order).alias("entry_page"),
        F.max_by("m_page", order).alias("exit_page"))
    return g.withColumn(
        "duration_s",
        (F.unix_micros(F.col("session_end").cast("timestamp")) -
         F.unix_micros(F.col("session_start").cast("timestamp"))) / F.lit(1e6))


def session_pages(events: DataFrame, frm=None, to=None) -> DataFrame:
    """The pages of every session in order (A23): (session_id, pos, page), a row
    per event with a page. Positions come from range partitioning, so a session
    of any length is spread over many tasks."""
    ev = _session_events(events, frm, to).filter(F.col("m_page").isNotNull()).select(
        F.col("m_session_id").alias("session_id"), F.col("m_page").alias("page"),
        "timestamp", "id")
    return ordered_positions(ev, ["timestamp", "id"], group="session_id").select(
        "session_id", "pos", "page")
