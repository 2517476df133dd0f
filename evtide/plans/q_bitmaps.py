"""Exact distinct users and sets of users from stored bitmaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from evtide.operators import bitmaps
from evtide.plans.oracle import sql, tsl
from evtide.plans.q_keyed import ACTIVE_SQL, DAYS
from evtide.plans.q_report import HITS_SQL, _build_rollup
from evtide.plans.registry import AS_OF, FROM, FROM_H, ORACLES, register, _t, TO, TO_H
from evtide.sources import schemas, sinks
from evtide.sources.driver_tables import stored_snapshot

MONTH = [f"active:{dt.date(2024, 1, 1) + dt.timedelta(days=i)}" for i in range(30)]
_MONTH_SQL = "key BETWEEN 'active:2024-01-01' AND 'active:2024-01-30'"


def _stored(spark, sf_dir):
    """The bitmaps of all stored hours, written once and read by every query."""
    base = stored_snapshot(spark, sf_dir, "user-bitmaps",
                           lambda t, base: bitmaps.write(bitmaps.hourly(t.events), base))
    return bitmaps.read(spark, base)


@register("report_exact_users_bitmaps", ORACLES["report_exact_users"])
def q_report_exact_users_bitmaps(spark, sf_dir):
    """Exact distinct users over the report window, from the snapshot alone."""
    return bitmaps.exact_unique_users(_stored(spark, sf_dir), _t(spark, sf_dir).event_types,
                                      FROM, TO, now=AS_OF)


_SPAN = f"slot BETWEEN {tsl(FROM_H)} AND {tsl(TO_H)}"


@register("stats_report_exact", sql(f"""
SELECT CASE WHEN grouping(what) = 0 THEN 'events' ELSE 'totals' END AS result_type,
       what AS event_type, count(*) AS "count", count(DISTINCT user_id) AS unique_users,
       CAST(NULL AS VARCHAR) AS page
FROM hits WHERE kind = 'event_type' AND {_SPAN} GROUP BY GROUPING SETS ((what), ())
UNION ALL
SELECT 'pages', NULL, n, NULL, what FROM (
  SELECT what, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, what) AS place
  FROM hits WHERE kind = 'page' AND {_SPAN} GROUP BY what) x WHERE place <= 10""", HITS_SQL))
def q_stats_report_exact(spark, sf_dir):
    """The statistics report with exact distinct users (A12 without Q4)."""
    base = stored_snapshot(spark, sf_dir, "rollup", _build_rollup)
    return bitmaps.exact_report(sinks.read_current(spark, base, schemas.ROLLUP),
                                _stored(spark, sf_dir), _t(spark, sf_dir).event_types,
                                FROM, TO, now=AS_OF)


@register("active_users_month", sql(
    f"SELECT DISTINCT member FROM active WHERE {_MONTH_SQL}", ACTIVE_SQL))
def q_active_users_month(spark, sf_dir):
    """Users active on any of 30 days."""
    sets = bitmaps.daily_sets(_stored(spark, sf_dir))
    return bitmaps.as_members(bitmaps.union(sets, MONTH))


@register("active_users_all_days", sql(
    "SELECT member FROM active WHERE key BETWEEN 'active:2024-01-10' AND 'active:2024-01-12' "
    "GROUP BY member HAVING count(DISTINCT key) = 3", ACTIVE_SQL))
def q_active_users_all_days(spark, sf_dir):
    """Users active on each of three days (U4)."""
    days = MONTH[9:12]
    sets = bitmaps.daily_sets(_stored(spark, sf_dir), [d.split(":")[1] for d in days])
    return bitmaps.as_members(bitmaps.intersect(sets, days))


@register("active_users_gone", sql(f"""
SELECT member FROM active WHERE {_MONTH_SQL} GROUP BY member
HAVING min(key) < 'active:2024-01-29' AND max(key) < 'active:2024-01-29'""", ACTIVE_SQL))
def q_active_users_gone(spark, sf_dir):
    """Users active on any of 28 days and neither of the last two."""
    sets = bitmaps.daily_sets(_stored(spark, sf_dir))
    return bitmaps.difference(sets, MONTH[:28], MONTH[28:]).selectExpr(
        "CAST(user_id AS STRING) AS member")


@register("active_sizes_bitmaps", sql(f"""
SELECT key, count(DISTINCT member) AS size FROM active WHERE {_MONTH_SQL} GROUP BY key
UNION ALL
SELECT 'beyond', count(DISTINCT member) FROM active WHERE key = '{DAYS[0]}' AND member NOT IN
  (SELECT member FROM active WHERE key IN ('{DAYS[1]}', '{DAYS[2]}'))""", ACTIVE_SQL))
def q_active_sizes_bitmaps(spark, sf_dir):
    """The size of every day's set (A25) and how many users a day has beyond two
    others, counted without listing anyone."""
    sets = bitmaps.daily_sets(_stored(spark, sf_dir)).where(F.col("key").isin(MONTH))
    beyond = bitmaps.difference_size(sets, DAYS[:1], DAYS[1:3])
    return bitmaps.sizes(sets, "key", col="size").unionByName(
        beyond.selectExpr("'beyond' AS key", "size"))
