"""Exact distinct users that merge: bitmaps per hour and per day.

A user id is a bit: bitmap number ``bitmap_bucket_number(id)``, 32,768 users each,
and a position in it. A row of the snapshot is one bitmap of one (type, hour). Any
hours, types and days are merged by OR, so a report over any range takes its exact
distinct users from the snapshot and never goes back to the events; the sum of hourly
distinct counts, which counts a user again in every hour, isn't needed. Sets of users
(a day's active users, say) are bitmaps, too: union is OR, intersection AND, difference
the bits of one set that are clear in the others.

A bitmap has 4 KB however few users are in it (Parquet packs the zeros), and groups
are merged bitmap by bitmap, so neither a hot type nor a hot hour is gathered: the rows
of a group are few per (type, hour, bitmap) after the partial aggregation. This is
for ids that are dense, as serial ids are; ids scattered over all 64 bits are better
served by the (hour, type, user) ledger or by sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtide.functions.timefn import lookback_start, parse_ts, trunc, ts, utcnow
from evtide.operators import deltas, report
from evtide.operators.joins import with_type_name
from evtide.sources import sinks

# Fixed values of Spark's bitmap functions: bits and bytes of a bitmap.
BITS, BYTES = 32768, 4096
SCHEMA = ("event_type_id int, hour_bucket timestamp_ntz, bucket bigint, users binary, "
          "event_date date")


# ---------------------------------------------------------------- building
def _bitmaps(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, users) of distinct (keys, user_id)."""
    return (pairs.where(F.col("user_id").isNotNull())
            .select(*keys, F.bitmap_bucket_number("user_id").alias("bucket"),
                    F.bitmap_bit_position("user_id").alias("pos"))
            .groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("pos").alias("users")))


def hourly(events: DataFrame, as_of=None, lookback_days: int | None = None) -> DataFrame:
    """(event_type_id, hour_bucket, bucket, users) of the events of the lookback,
    all events without one."""
    if lookback_days is not None:
        lo = lookback_start(parse_ts(as_of) or utcnow(), lookback_days)
        events = events.where(F.col("timestamp") >= ts(lo))
    pairs = events.select("event_type_id", trunc("hour", "timestamp").alias("hour_bucket"),
                          "user_id").distinct()
    return _bitmaps(pairs, "event_type_id", "hour_bucket")


def from_ledger(ledger: DataFrame) -> DataFrame:
    """The same from the ledger of signed changes (``operators.deltas``)."""
    there = ledger.where((F.col("kind") == deltas.TYPE) & (F.col("n") > 0))
    return _bitmaps(there.select("event_type_id", "hour_bucket", "user_id"),
                    "event_type_id", "hour_bucket")


def write(hours: DataFrame, base: str) -> str:
    """Write hourly bitmaps as a new version, by day, clustered by hour."""
    dated = hours.withColumn("event_date", F.to_date("hour_bucket"))
    return sinks.write_version(
        dated.repartitionByRange("event_date", "hour_bucket", "event_type_id", "bucket")
        .sortWithinPartitions("event_date", "hour_bucket", "event_type_id", "bucket"),
        base, partition_by=["event_date"])


def read(spark, base: str) -> DataFrame:
    """The current version."""
    return sinks.read_current(spark, base, SCHEMA)


# ---------------------------------------------------------------- distinct counts
def merged(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps put together over everything but ``keys``."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def sizes(bitmaps: DataFrame, *keys: str, col: str = "unique_users") -> DataFrame:
    """Exact number of distinct users for each of ``keys``."""
    return merged(bitmaps, *keys).groupBy(*keys).agg(
        F.sum(F.bitmap_count("users")).alias(col))


def in_hours(bitmaps: DataFrame, frm_r, to_r) -> DataFrame:
    """Both hours inclusive; days outside are not read."""
    frm_r, to_r = parse_ts(frm_r), parse_ts(to_r)
    inside = bitmaps.where((F.col("hour_bucket") >= ts(frm_r)) & (F.col("hour_bucket") <= ts(to_r)))
    if "event_date" in bitmaps.columns:
        inside = inside.where(F.col("event_date").between(F.lit(frm_r.date()),
                                                          F.lit(to_r.date())))
    return inside


def exact_unique_users(bitmaps: DataFrame, event_types: DataFrame, frm=None, to=None,
                       event_type: str | None = None, now=None) -> DataFrame:
    """``report.exact_unique_users`` from the snapshot alone: one ``events`` row
    per type and a ``totals`` row with the users of all of them."""
    _, _, frm_r, to_r = report.report_range(frm, to, now)
    inside = in_hours(bitmaps, frm_r, to_r)
    if event_type is not None:
        ids = event_types.where(F.col("name") == event_type).select(
            F.col("id").alias("event_type_id"))
        inside = inside.join(ids, "event_type_id", "left_semi")
    per = merged(inside, "event_type_id")
    named = with_type_name(per.groupBy("event_type_id").agg(
        F.sum(F.bitmap_count("users")).alias("unique_users")), event_types)
    total = merged(per).agg(F.coalesce(F.sum(F.bitmap_count("users")), F.lit(0))
                            .cast("bigint").alias("unique_users"))
    return named.select(F.lit("events").alias("result_type"), "event_type", "unique_users") \
        .unionByName(total.select(F.lit("totals").alias("result_type"),
                                  F.lit(None).cast("string").alias("event_type"), "unique_users"))


def exact_report(rollup: DataFrame, bitmaps: DataFrame, event_types: DataFrame, frm=None, to=None,
                 event_type: str | None = None, now=None) -> DataFrame:
    """The statistics report (A12) with exact distinct users per type and in all,
    from the two snapshots."""
    plain = report.stats_report(rollup, frm, to, event_type, now)
    exact = exact_unique_users(bitmaps, event_types, frm, to, event_type, now).select(
        F.col("result_type").alias("_r"), F.col("event_type").alias("_t"),
        F.col("unique_users").alias("_u"))
    same = (F.col("result_type") == F.col("_r")) & F.col("event_type").eqNullSafe(F.col("_t"))
    return plain.join(exact, same, "left").select(
        "result_type", "event_type", "count", F.col("_u").alias("unique_users"), "page").orderBy(
        "result_type", F.col("count").desc(), "event_type", "page")


# ---------------------------------------------------------------- sets of users
def daily_sets(bitmaps: DataFrame, days: list[str] | None = None) -> DataFrame:
    """(key, bucket, users): the active users of each day as a keyed set."""
    day = F.to_date("hour_bucket")
    if days is not None:
        bitmaps = bitmaps.where(day.isin(days))
        if "event_date" in bitmaps.columns:
            bitmaps = bitmaps.where(F.col("event_date").isin(days))
    return merged(bitmaps.withColumn("key", F.concat(F.lit("active:"), day.cast("string"))), "key")


def sets_of(members: DataFrame) -> DataFrame:
    """(key, bucket, users) of a table of (key, user_id)."""
    return _bitmaps(members.select("key", "user_id").distinct(), "key")


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, users) of any of ``keys``."""
    return merged(sets.where(F.col("key").isin(keys)).select("bucket", "users"))


def intersect(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, users) of all ``keys`` (U4): a bitmap that one of them lacks is empty."""
    n = len(set(keys))
    each = merged(sets.where(F.col("key").isin(keys)), "key")
    return (each.groupBy("bucket").agg(F.bitmap_and_agg("users").alias("users"),
                                       F.count(F.lit(1)).alias("_n"))
            .where((F.col("_n") == n) & (F.bitmap_count("users") > 0)).select("bucket", "users"))


def _byte(users: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of a bitmap."""
    return F.conv(F.hex(F.substring(users, i + 1, F.lit(1))), 16, 10).cast("int")


def members(bitmaps: DataFrame) -> DataFrame:
    """(bitmaps' other columns, bucket, pos, user_id): a row per user, in two
    steps: bytes that hold any, then their bits."""
    rest = [c for c in bitmaps.columns if c != "users"]
    at = bitmaps.select(*rest, "users", F.explode(F.sequence(F.lit(0), F.lit(BYTES - 1)))
                        .alias("_i"))
    held = at.select(*rest, "_i", _byte(F.col("users"), F.col("_i")).alias("_b")).where("_b != 0")
    bits = held.select(*rest, "_i", "_b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k")) \
        .where(F.expr("(shiftright(_b, _k) & 1) = 1"))
    pos = (F.col("_i") * 8 + F.col("_k")).cast("bigint")
    # ids from 1 on fill bitmaps from 1 on; 0 and less fill them downwards
    user = (F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + pos + 1)
            .otherwise(F.col("bucket") * BITS - pos))
    return bits.select(*rest, pos.alias("pos"), user.alias("user_id"))


def difference(sets: DataFrame, first: list[str], others: list[str]) -> DataFrame:
    """(user_id) of any of ``first`` and none of ``others``."""
    mine = union(sets, first)
    # only bitmaps that both sides have are compared bit by bit
    seen = members(union(sets, others).join(mine.select("bucket"), "bucket", "left_semi"))
    return members(mine).join(seen.select("bucket", "pos"), ["bucket", "pos"],
                              "left_anti").select("user_id")


def difference_size(sets: DataFrame, first: list[str], others: list[str]) -> DataFrame:
    """How many users ``first`` has beyond ``others``: by bitmap, the bits of
    both together less those of the others."""
    both = sets.where(F.col("key").isin([*first, *others])).groupBy("bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("users")).alias("_all"),
        F.bitmap_count(F.bitmap_or_agg(F.when(F.col("key").isin(others), F.col("users"))))
        .alias("_rest"))
    return both.agg(F.coalesce(F.sum(F.col("_all") - F.coalesce("_rest", F.lit(0))), F.lit(0))
                    .cast("bigint").alias("size"))


def as_members(bitmaps: DataFrame) -> DataFrame:
    """(member) of a merged set, as text, as the keyed sets have it."""
    return members(bitmaps).select(F.col("user_id").cast("string").alias("member"))
