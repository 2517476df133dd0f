"""Hourly rollup snapshot (A6-A8) and its mergeable-sketch twin.

The rollup is a pre-aggregate: (stat_type, key_name, hour_bucket) with
counts. It is tiny next to the events (types x hours + pages x hours), so the
report reads it instead of the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.functions.metadata import with_hot_columns
from evtide.functions.timefn import lookback_start, parse_ts, trunc, ts, utcnow
from evtide.operators.joins import with_type_name

LOOKBACK_DAYS = 30


def _null(t: str):
    return F.lit(None).cast(t)


def _window(events: DataFrame, as_of, lookback_days: int) -> DataFrame:
    # Lower bound only: future-dated events stay in (the first hour is partial).
    as_of = parse_ts(as_of) or utcnow()
    return events.filter(F.col("timestamp") >= ts(lookback_start(as_of, lookback_days)))


def type_rollup(events: DataFrame, event_types: DataFrame, as_of=None,
                lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Per (type, hour): event count and distinct users.

    Aggregates on the integer type id, then attaches the name to the
    aggregated rows only.
    """
    ev = _window(events, as_of, lookback_days)
    per = ev.groupBy("event_type_id", trunc("hour", "timestamp").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.countDistinct("user_id").alias("unique_users"))
    return with_type_name(per, event_types).select(
        F.col("event_type"), "hour_bucket", "total_count", "unique_users")


def page_rollup(events: DataFrame, as_of=None,
                lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Per (page, hour) among rows that have a ``page`` key.

    A JSON-null page and a literal "unknown" page fall in the same
    ``unknown`` row (grouped by the shown value, so the snapshot key stays
    unique). Reads the columns extracted at ingest.
    """
    ev = with_hot_columns(_window(events, as_of, lookback_days)).filter(F.col("m_has_page"))
    page = F.coalesce("m_page_text", F.lit("unknown"))
    return ev.groupBy(page.alias("page"), trunc("hour", "timestamp").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("page_count"))


def stats_rollup(events: DataFrame, event_types: DataFrame, as_of=None,
                 lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """The combined snapshot, six columns with typed nulls."""
    t = type_rollup(events, event_types, as_of, lookback_days).select(
        F.lit("event_type").alias("stat_type"), F.col("event_type").alias("key_name"),
        "hour_bucket", "total_count", "unique_users", _null("long").alias("page_count"))
    p = page_rollup(events, as_of, lookback_days).select(
        F.lit("page").alias("stat_type"), F.col("page").alias("key_name"),
        "hour_bucket", _null("long").alias("total_count"), _null("long").alias("unique_users"),
        "page_count")
    return t.unionByName(p)


# ---------------------------------------------------------------- A24
def sketch_rollup(events: DataFrame, event_types: DataFrame, as_of=None,
                  lookback_days: int = LOOKBACK_DAYS, lg_k: int = 12) -> DataFrame:
    """Per (type, hour): count plus an HLL sketch of the users.

    Sketches merge, so distinct users over any set of hours is a union of
    sketches, not the over-counting sum of hourly distinct counts.
    """
    ev = _window(events, as_of, lookback_days)
    per = ev.groupBy("event_type_id", trunc("hour", "timestamp").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.hll_sketch_agg("user_id", lg_k).alias("users_sketch"))
    return with_type_name(per, event_types).select(
        "event_type", "hour_bucket", "total_count", "users_sketch")


def sketch_unique_users(sketches: DataFrame, frm=None, to=None,
                        by_type: bool = True) -> DataFrame:
    """Distinct users over an hour range from the sketch rollup."""
    s = sketches
    if frm is not None:
        s = s.filter(F.col("hour_bucket") >= ts(parse_ts(frm)))
    if to is not None:
        s = s.filter(F.col("hour_bucket") <= ts(parse_ts(to)))
    keys = ["event_type"] if by_type else []
    return s.groupBy(*keys).agg(
        F.sum("total_count").alias("total_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("unique_users_est"))
