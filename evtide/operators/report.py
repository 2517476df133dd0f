"""The statistics report over the rollup snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.functions.timefn import check_range, floor_hour, parse_ts, ts, utcnow

DEFAULT_DAYS = 30
TOP_PAGES = 10


def _null(t: str):
    return F.lit(None).cast(t)


def _hours(rollup: DataFrame, stat_type: str, frm_r, to_r) -> DataFrame:
    # Both rounded ends inclusive: the whole 'to' hour counts.
    return rollup.filter((F.col("stat_type") == stat_type) &
                         (F.col("hour_bucket") >= ts(frm_r)) &
                         (F.col("hour_bucket") <= ts(to_r)))


def report_range(frm=None, to=None, now=None):
    """Defaults (to = now, from = to - 30 days), validation, hour rounding.

    Returns (from, to, from_rounded, to_rounded).
    """
    check_range(frm, to)
    now = parse_ts(now) or utcnow()
    frm = parse_ts(frm) or now - dt.timedelta(days=DEFAULT_DAYS)
    to = parse_ts(to) or now
    return frm, to, floor_hour(frm), floor_hour(to)


def per_type(rollup: DataFrame, frm_r, to_r, event_type: str | None = None) -> DataFrame:
    """Hourly rows re-aggregated per type (A9). ``unique_users`` is the sum of
    hourly distinct counts (an over-count, kept for parity)."""
    r = _hours(rollup, "event_type", frm_r, to_r)
    if event_type is not None:
        r = r.filter(F.col("key_name") == F.lit(event_type))
    return r.groupBy(F.col("key_name").alias("event_type")).agg(
        F.sum("total_count").cast("long").alias("total_count"),
        F.sum("unique_users").cast("long").alias("unique_users"))


def totals(per_type_df: DataFrame) -> DataFrame:
    """Grand totals, zero when empty (A10)."""
    return per_type_df.agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).cast("long").alias("total_events"),
        F.coalesce(F.sum("unique_users"), F.lit(0)).cast("long").alias("total_unique_users"))


def top_pages_from_rollup(rollup: DataFrame, frm_r, to_r, limit: int = TOP_PAGES) -> DataFrame:
    """Top pages of the hour range, *not* filtered by type."""
    r = _hours(rollup, "page", frm_r, to_r)
    return (r.groupBy(F.col("key_name").alias("page"))
            .agg(F.sum("page_count").cast("long").alias("count"))
            .orderBy(F.col("count").desc(), F.col("page"))
            .limit(limit))


def stats_report(rollup: DataFrame, frm=None, to=None, event_type: str | None = None,
                 now=None) -> DataFrame:
    """The flagship report in long form.

    Rows: ``events`` per type, one ``totals`` row, up to ten ``pages``; columns
    (result_type, event_type, count, unique_users, page), ordered by
    result_type then count descending (then a unique key).
    """
    _, _, frm_r, to_r = report_range(frm, to, now)
    pt = per_type(rollup, frm_r, to_r, event_type)
    ev_rows = pt.select(F.lit("events").alias("result_type"), "event_type",
                        F.col("total_count").alias("count"), "unique_users",
                        _null("string").alias("page"))
    tot_rows = totals(pt).select(F.lit("totals").alias("result_type"),
                                 _null("string").alias("event_type"),
                                 F.col("total_events").alias("count"),
                                 F.col("total_unique_users").alias("unique_users"),
                                 _null("string").alias("page"))
    pg_rows = top_pages_from_rollup(rollup, frm_r, to_r).select(
        F.lit("pages").alias("result_type"), _null("string").alias("event_type"), "count",
        _null("long").alias("unique_users"), "page")
    return (ev_rows.unionByName(tot_rows).unionByName(pg_rows)
            .orderBy("result_type", F.col("count").desc(), "event_type", "page"))


def nested_report(report: DataFrame, frm=None, to=None, now=None) -> DataFrame:
    """Single-row nested form (A13): totals, type array, page array, range.

    Gathers only the report's own rows (types + 11), never fact rows.
    """
    frm, to, _, _ = report_range(frm, to, now)
    agg = report.agg(
        F.coalesce(F.max(F.when(F.col("result_type") == "totals", F.col("count"))),
                   F.lit(0).cast("long")).alias("total_events"),
        F.coalesce(F.max(F.when(F.col("result_type") == "totals", F.col("unique_users"))),
                   F.lit(0).cast("long")).alias("unique_users"),
        F.collect_list(F.when(F.col("result_type") == "events", F.struct(
            (-F.col("count")).alias("k"), "event_type", "count"))).alias("_types"),
        F.collect_list(F.when(F.col("result_type") == "pages", F.struct(
            (-F.col("count")).alias("k"), "page", "count"))).alias("_pages"))
    return agg.select(
        "total_events", "unique_users",
        F.transform(F.array_sort("_types"),
                    lambda x: F.struct(x["event_type"].alias("event_type"),
                                       x["count"].alias("count"))).alias("event_types"),
        F.transform(F.array_sort("_pages"),
                    lambda x: F.struct(x["page"].alias("page"),
                                       x["count"].alias("count"))).alias("top_pages"),
        F.struct(ts(frm).alias("from"), ts(to).alias("to")).alias("time_range"))


def exact_unique_users(events: DataFrame, event_types: DataFrame, frm=None, to=None,
                       event_type: str | None = None, now=None, as_of=None,
                       lookback_days: int = 30) -> DataFrame:
    """Exact distinct users over the report's window (repairs Q4).

    Same window as ``stats_report`` -- hours ``floor(from) .. floor(to)``
    inclusive, i.e. ``[floor(from), floor(to) + 1 hour)``, and no earlier
    than the rollup's lookback from ``as_of`` -- but counted from the events:
    one ``events`` row per type and a ``totals`` row with the true overall
    distinct count (not the sum of the per-type numbers).
    """
    from evtide.functions.timefn import lookback_start
    from evtide.operators.joins import restrict_type
    _, _, frm_r, to_r = report_range(frm, to, now)
    lo = frm_r
    if as_of is not None:
        lo = max(lo, lookback_start(as_of, lookback_days))
    ev = events.filter((F.col("timestamp") >= ts(lo)) &
                       (F.col("timestamp") < ts(to_r + dt.timedelta(hours=1))))
    ev = restrict_type(ev, event_types, event_type)
    # one scan: distinct (type, user) pairs, folded by type and over all at once
    pairs = ev.select("event_type_id", "user_id").distinct()
    folded = pairs.groupingSets([[F.col("event_type_id")], []], F.col("event_type_id")).agg(
        F.grouping("event_type_id").alias("_all"),
        F.countDistinct("user_id").alias("unique_users"))
    names = event_types.select(F.col("id").alias("event_type_id"),
                               F.col("name").alias("event_type"))
    named = folded.join(names, "event_type_id", "left").select(
        F.when(F.col("_all") == 1, "totals").otherwise("events").alias("result_type"),
        "event_type", "unique_users")
    # without events there is no total either: a zero stands in for it
    zero = events.sparkSession.range(1).select(
        F.lit("totals").alias("result_type"), _null("string").alias("event_type"),
        F.lit(0).cast("long").alias("unique_users"))
    return named.unionByName(zero).groupBy("result_type", "event_type").agg(
        F.max("unique_users").alias("unique_users"))
