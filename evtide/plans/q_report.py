"""Rollup, statistics report, direct metrics and documented analytics."""

from __future__ import annotations

from evtide.operators import metrics, report, rollup
from evtide.plans.oracle import has_page, sql, tsl
from evtide.plans.registry import (
    ABSENT_TYPE, AS_OF, AT, FROM, FROM_H, _range_where, register, _t, TO, TO_H, TYPE,
    _TYPED_JOIN,
)
from evtide.sources import schemas, sinks
from evtide.sources.driver_tables import stored_snapshot
from evtide.streaming import streams


# One row per event and thing it counts for: its type and, where the metadata
# has a page key, its page. Every expected figure is one aggregate of these.
HITS_SQL = f"""
hits AS (
  SELECT time_bucket(INTERVAL 1 HOUR, e."timestamp") AS slot, e.user_id, v.kind,
         CASE v.kind WHEN 'event_type' THEN (SELECT name FROM c_event_types
                                             WHERE id = e.event_type_id)
              ELSE ifnull(e.metadata ->> '$.page', 'unknown') END AS what
  FROM c_events e, (VALUES ('event_type'), ('page')) v(kind)
  WHERE NOT (e."timestamp" < {tsl(AS_OF)} - INTERVAL 30 DAY)
    AND (v.kind = 'event_type' OR {has_page('e.metadata')}))"""

ROLLUP_SQL = HITS_SQL + """,
rollup AS (
  SELECT kind AS stat_type, what AS key_name, slot AS hour_bucket,
         CASE kind WHEN 'event_type' THEN count(*) END AS total_count,
         CASE kind WHEN 'event_type' THEN count(DISTINCT user_id) END AS unique_users,
         CASE kind WHEN 'page' THEN count(*) END AS page_count
  FROM hits GROUP BY kind, what, slot)"""


@register("stats_rollup", sql("SELECT * FROM rollup", ROLLUP_SQL))
def q_stats_rollup(spark, sf_dir):
    t = _t(spark, sf_dir)
    return rollup.stats_rollup(t.hot, t.event_types, as_of=AS_OF)


def _report_sql(type_name: str | None) -> str:
    only = "TRUE" if type_name is None else f"what = '{type_name}'"
    span = f"slot BETWEEN {tsl(FROM_H)} AND {tsl(TO_H)}"
    # hourly distinct users added up are the distinct (hour, user) pairs
    return sql(f"""
SELECT 'events' AS result_type, what AS event_type, count(*) AS "count",
       count(DISTINCT (slot, user_id)) AS unique_users, CAST(NULL AS VARCHAR) AS page
FROM hits WHERE kind = 'event_type' AND {span} AND {only} GROUP BY what
UNION ALL
SELECT 'totals', NULL, count(*), count(DISTINCT (slot, what, user_id)), NULL
FROM hits WHERE kind = 'event_type' AND {span} AND {only}
UNION ALL
SELECT 'pages', NULL, n, NULL, what FROM (
  SELECT what, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, what) AS place
  FROM hits WHERE kind = 'page' AND {span} GROUP BY what) x WHERE place <= 10""", HITS_SQL)


def _build_rollup(t, base: str) -> None:
    streams.refresh_rollup(t.hot, t.event_types, base, as_of=AS_OF)


def _report(spark, sf_dir, type_name):
    """The report over the current version of the rollup snapshot (S9), which
    the rollup job (W18) has built before and keeps."""
    base = stored_snapshot(spark, sf_dir, "rollup", _build_rollup)
    snap = sinks.read_current(spark, base, schemas.ROLLUP)
    return report.stats_report(snap, FROM, TO, type_name, now=AS_OF)


@register("stats_report", _report_sql(None))
def q_stats_report(spark, sf_dir):
    return _report(spark, sf_dir, None)


@register("stats_report_typed", _report_sql(TYPE))
def q_stats_report_typed(spark, sf_dir):
    return _report(spark, sf_dir, TYPE)


@register("stats_report_absent_type", _report_sql(ABSENT_TYPE))
def q_stats_report_absent(spark, sf_dir):
    return _report(spark, sf_dir, ABSENT_TYPE)


@register("count_events", sql(f'SELECT count(*) AS "count" FROM c_events e WHERE {_range_where()}'))
def q_count_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.count_events(t.events, t.event_types, FROM, TO)


@register("count_events_typed", sql(
    f"SELECT count(*) AS \"count\" FROM c_events e {_TYPED_JOIN} "
    f"WHERE {_range_where()} AND t.name = '{TYPE}'"))
def q_count_events_typed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.count_events(t.events, t.event_types, FROM, TO, TYPE)


@register("unique_users", sql(
    f"SELECT count(DISTINCT user_id) AS unique_users FROM c_events e WHERE {_range_where()}"))
def q_unique_users(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.unique_users(t.events, t.event_types, FROM, TO)


@register("unique_users_typed", sql(
    f"SELECT count(DISTINCT e.user_id) AS unique_users FROM c_events e {_TYPED_JOIN} "
    f"WHERE {_range_where()} AND t.name = '{TYPE}'"))
def q_unique_users_typed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.unique_users(t.events, t.event_types, FROM, TO, TYPE)


@register("event_type_stats", sql(
    f"SELECT t.name AS event_type, count(*) AS \"count\" FROM c_events e {_TYPED_JOIN} "
    f"WHERE {_range_where()} GROUP BY t.name"))
def q_event_type_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.event_type_stats(t.events, t.event_types, FROM, TO)


def _top_pages_sql(type_name):
    tf = "" if type_name is None else f"AND t.name = '{type_name}'"
    return sql(f"""
SELECT coalesce(raw, 'unknown') AS page, "count" FROM (
  SELECT json_extract_string(e.metadata, '$.page') AS raw, count(*) AS "count"
  FROM c_events e {_TYPED_JOIN}
  WHERE {_range_where()} AND {has_page('e.metadata')} {tf}
  GROUP BY 1) g
ORDER BY "count" DESC, coalesce(raw, 'unknown'), raw NULLS FIRST LIMIT 10""")


@register("top_pages", _top_pages_sql(None))
def q_top_pages(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.top_pages(t.hot, t.event_types, FROM, TO, None, 10)


@register("top_pages_typed", _top_pages_sql(TYPE))
def q_top_pages_typed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.top_pages(t.hot, t.event_types, FROM, TO, TYPE, 10)


def _bucket_sql(unit: str, where: str) -> str:
    return sql(f"""
SELECT p.bucket_start, t.name AS event_type, p.type_count, b.total_events, b.unique_users
FROM (SELECT date_trunc('{unit}', "timestamp") AS bucket_start, event_type_id,
             count(*) AS type_count FROM c_events e WHERE {where} GROUP BY 1, 2) p
JOIN c_event_types t ON p.event_type_id = t.id
JOIN (SELECT date_trunc('{unit}', "timestamp") AS bucket_start, count(*) AS total_events,
             count(DISTINCT user_id) AS unique_users FROM c_events e WHERE {where} GROUP BY 1) b
  ON p.bucket_start = b.bucket_start""")


@register("realtime_metrics", _bucket_sql(
    "hour", f"date_trunc('hour', \"timestamp\") = date_trunc('hour', {tsl(AT)})"))
def q_realtime_metrics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.realtime_metrics(t.events, t.event_types, "hour", at=AT)


@register("timeseries_hour", _bucket_sql("hour", _range_where()))
def q_timeseries_hour(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.timeseries(t.events, t.event_types, "hour", FROM, TO)


@register("timeseries_day", sql(f"""
SELECT g.bucket_start, s.event_type, coalesce(s.type_count, 0) AS type_count,
       coalesce(s.total_events, 0) AS total_events, coalesce(s.unique_users, 0) AS unique_users
FROM (SELECT unnest(generate_series(date_trunc('day', {tsl(FROM)}),
                                    date_trunc('day', {tsl(TO)}), INTERVAL 1 DAY))
             AS bucket_start) g
LEFT JOIN series s ON s.bucket_start = g.bucket_start""", f"""
series AS (
SELECT p.bucket_start, t.name AS event_type, p.type_count, b.total_events, b.unique_users
FROM (SELECT date_trunc('day', "timestamp") AS bucket_start, event_type_id,
             count(*) AS type_count FROM c_events e
      WHERE {_range_where()} AND event_type_id = 3 GROUP BY 1, 2) p
JOIN c_event_types t ON p.event_type_id = t.id
JOIN (SELECT date_trunc('day', "timestamp") AS bucket_start, count(*) AS total_events,
             count(DISTINCT user_id) AS unique_users FROM c_events e
      WHERE {_range_where()} AND event_type_id = 3 GROUP BY 1) b
  ON p.bucket_start = b.bucket_start)"""))
def q_timeseries_day(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.timeseries(t.events, t.event_types, "day", FROM, TO,
                              event_type="purchase", fill_gaps=True)


@register("hourly_summary", sql(f"""
SELECT e.event_type_id, t.name AS event_type, date_trunc('hour', e."timestamp") AS hour_bucket,
       count(*) AS total_count, count(DISTINCT e.user_id) AS unique_users
FROM c_events e {_TYPED_JOIN}
WHERE {_range_where()} AND e.event_type_id IN (1, 3)
GROUP BY 1, 2, 3"""))
def q_hourly_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.hourly_summary(t.events, t.event_types, FROM, TO, type_ids=[1, 3])


@register("user_activity", sql(f"""
SELECT user_id, count(*) AS event_count, count(DISTINCT event_type_id) AS distinct_types,
       min("timestamp") AS first_seen, max("timestamp") AS last_seen
FROM c_events e WHERE {_range_where()} GROUP BY user_id"""))
def q_user_activity(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.user_activity(t.events, FROM, TO)


POPULAR_AS_OF = "2024-01-20 00:00:00"


def _popular_sql(period: str, days: int, limit: int) -> str:
    return sql(f"""
SELECT '{period}' AS period, t.name AS event_type, count(*) AS "count",
       count(DISTINCT e.user_id) AS unique_users
FROM c_events e {_TYPED_JOIN}
WHERE e."timestamp" BETWEEN {tsl(POPULAR_AS_OF)} - INTERVAL {days} DAY AND {tsl(POPULAR_AS_OF)}
GROUP BY t.name ORDER BY "count" DESC, event_type LIMIT {limit}""")


@register("popular_events", _popular_sql("weekly", 7, 3))
def q_popular_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.popular_events(t.events, t.event_types, "weekly", POPULAR_AS_OF, 3)


@register("popular_events_daily", _popular_sql("daily", 1, 4))
def q_popular_events_daily(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.popular_events(t.events, t.event_types, "daily", POPULAR_AS_OF, 4)


@register("popular_events_monthly", _popular_sql("monthly", 30, 10))
def q_popular_events_monthly(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.popular_events(t.events, t.event_types, "monthly", POPULAR_AS_OF)


@register("users_with_metrics", sql("""
SELECT u.id, u.name, u.created_at, coalesce(a.event_count, 0) AS event_count,
       coalesce(a.distinct_types, 0) AS distinct_types,
       coalesce(a.distinct_pages, 0) AS distinct_pages, a.first_seen, a.last_seen
FROM c_users u LEFT JOIN (
  SELECT user_id, count(*) AS event_count, count(DISTINCT event_type_id) AS distinct_types,
         count(DISTINCT page) AS distinct_pages, min("timestamp") AS first_seen,
         max("timestamp") AS last_seen
  FROM c_typed GROUP BY user_id) a ON a.user_id = u.id"""))
def q_users_with_metrics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.users_with_metrics(t.users, t.hot)


@register("page_analytics", sql("""
SELECT page, count(*) AS events, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT session_id) AS unique_sessions
FROM c_typed WHERE page IS NOT NULL GROUP BY page"""))
def q_page_analytics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.page_analytics(t.hot)


@register("referrer_analytics", sql("""
SELECT regexp_extract(referrer, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) AS host,
       count(*) AS events, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT session_id) AS unique_sessions
FROM c_typed WHERE referrer IS NOT NULL GROUP BY 1"""))
def q_referrer_analytics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.referrer_analytics(t.hot, by="host")


@register("referrer_analytics_full", sql("""
SELECT referrer, count(*) AS events, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT session_id) AS unique_sessions
FROM c_typed WHERE referrer IS NOT NULL GROUP BY 1"""))
def q_referrer_analytics_full(spark, sf_dir):
    """A21 by the whole referrer."""
    return metrics.referrer_analytics(_t(spark, sf_dir).hot, by="referrer")


@register("session_pages", sql("""
SELECT session_id, page,
       row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", id) - 1 AS pos
FROM c_typed WHERE session_id IS NOT NULL AND page IS NOT NULL"""))
def q_session_pages(spark, sf_dir):
    """The pages of every session in order."""
    return metrics.session_pages(_t(spark, sf_dir).hot)


@register("product_analytics", sql(f"""
SELECT e.product_id, t.name AS event_type, count(*) AS events,
       count(DISTINCT e.user_id) AS unique_users
FROM c_typed e {_TYPED_JOIN} WHERE e.product_id IS NOT NULL GROUP BY 1, 2"""))
def q_product_analytics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.product_analytics(t.hot, t.event_types)


@register("sessions", sql("""
SELECT session_id, min(user_id) AS user_id, min("timestamp") AS session_start,
       max("timestamp") AS session_end, count(*) AS events,
       count(DISTINCT page) AS distinct_pages,
       arg_min_null(page, ("timestamp", id)) AS entry_page,
       arg_max_null(page, ("timestamp", id)) AS exit_page,
       (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 AS duration_s
FROM c_typed WHERE session_id IS NOT NULL GROUP BY session_id"""))
def q_sessions(spark, sf_dir):
    t = _t(spark, sf_dir)
    return metrics.sessions(t.hot)


MINUTE_FROM, MINUTE_TO = "2024-01-15 10:00:00", "2024-01-15 13:59:59"


@register("timeseries_minute", _bucket_sql(
    "minute", f'e."timestamp" >= {tsl(MINUTE_FROM)} AND e."timestamp" <= {tsl(MINUTE_TO)}'))
def q_timeseries_minute(spark, sf_dir):
    """Minute buckets over four hours (A15 with F3)."""
    t = _t(spark, sf_dir)
    return metrics.timeseries(t.events, t.event_types, "minute", MINUTE_FROM, MINUTE_TO)


RT_USERS = (3, 7, 11, 12, 40)


@register("realtime_metrics_users", _bucket_sql(
    "day", f"date_trunc('day', \"timestamp\") = date_trunc('day', {tsl(AT)}) "
           f"AND user_id IN ({', '.join(map(str, RT_USERS))})"))
def q_realtime_metrics_users(spark, sf_dir):
    """A14 for the day bucket of AT, restricted to a list of users."""
    t = _t(spark, sf_dir)
    return metrics.realtime_metrics(t.events, t.event_types, "day", at=AT,
                                    user_ids=list(RT_USERS))


PIVOT_TYPES = ("purchase", "view", "click")


@register("product_pivot", sql(f"""
SELECT e.product_id,
       {", ".join(f"count(*) FILTER (WHERE t.name = '{n}') AS {n}" for n in PIVOT_TYPES)}
FROM c_typed e {_TYPED_JOIN} WHERE e.product_id IS NOT NULL GROUP BY e.product_id"""))
def q_product_pivot(spark, sf_dir):
    """Per product id, one event-count column per listed type (A22, wide)."""
    t = _t(spark, sf_dir)
    return metrics.product_pivot(t.hot, t.event_types, list(PIVOT_TYPES))


@register("report_exact_users", sql(f"""
SELECT 'events' AS result_type, t.name AS event_type,
       count(DISTINCT e.user_id) AS unique_users
FROM c_events e {_TYPED_JOIN}
WHERE e."timestamp" >= {tsl(FROM_H)} AND e."timestamp" < {tsl(TO_H)} + INTERVAL 1 HOUR
GROUP BY t.name
UNION ALL
SELECT 'totals', NULL, count(DISTINCT user_id) FROM c_events e
WHERE e."timestamp" >= {tsl(FROM_H)} AND e."timestamp" < {tsl(TO_H)} + INTERVAL 1 HOUR"""))
def q_report_exact_users(spark, sf_dir):
    """Exact distinct users over the report window, per type and overall (Q4)."""
    t = _t(spark, sf_dir)
    return report.exact_unique_users(t.events, t.event_types, FROM, TO, now=AS_OF, as_of=AS_OF)
