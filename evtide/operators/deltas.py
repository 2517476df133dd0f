"""The hourly rollup kept by signed changes, hour by hour.

A full rebuild scans 30 days of events. Here every batch that changes events
leaves a small table of signed changes per (hour, type, user) and (hour, page): +1
for an event that came, -1 for one that went, both for one that was updated. The
*ledger* holds their sums, so it knows how many events each user has in an hour
and can take one back without asking the events: a user whose count falls to zero
is no longer one of the hour's distinct users. Applying a batch reads and rewrites
the hours it touches, in the ledger and in the rollup made from it, and nothing else.
Late rows and future ones touch their own hours, however old.

Layout under ``base``, all Parquet:

* ``changes/writer=W/seq=N``: a batch's signed changes. Every writer (a stream, the
  batch jobs) counts its own batches up; a replayed batch overwrites its own;
* ``ledger/hour_key=...``: sums per hour. Marks in every hour say up to which batch
  of each writer it is summed, so a batch that was applied in part, or is replayed
  later, is not counted twice;
* ``rollup/hour_key=...``: total, distinct users and page counts per hour, by type
  id; names are attached when it is read, so a rename (W9) touches nothing.

One job applies batches at a time; readers see an hour as of one batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.functions.metadata import with_hot_columns
from evtide.functions.timefn import floor_hour, lookback_start, parse_ts, trunc, ts, utcnow
from evtide.operators import rollup as full
from evtide.operators.joins import with_type_name
from evtide.session import delete_path, hadoop_path, path_exists
from evtide.sources import schemas, sinks

#: One signed change: ``kind`` says whether it counts for a type and user or a page.
CHANGES = ("hour_bucket timestamp_ntz, kind string, event_type_id int, page string, "
           "user_id bigint, n bigint")
LEDGER = CHANGES + ", hour_key string"
HOURS = ("hour_bucket timestamp_ntz, stat_type string, event_type_id int, page string, "
         "total_count bigint, unique_users bigint, page_count bigint, hour_key string")
TYPE, PAGE, MARK = "event_type", "page", "applied"
_KEYS = ("hour_bucket", "kind", "event_type_id", "page", "user_id")


def hour_key(hour) -> F.Column:
    """The partition value of an hour: text without characters that paths escape."""
    return F.date_format(hour, "yyyy-MM-dd'T'HH")


# ---------------------------------------------------------------- what a batch changes
def changes(events: DataFrame, sign: int = 1) -> DataFrame:
    """Signed changes of events that came (+1) or went (-1), pre-aggregated."""
    hour = trunc("hour", "timestamp").alias("hour_bucket")
    n = (F.count(F.lit(1)) * sign).alias("n")
    by_user = events.groupBy(hour, "event_type_id", "user_id").agg(n).select(
        "hour_bucket", F.lit(TYPE).alias("kind"), "event_type_id",
        F.lit(None).cast("string").alias("page"), "user_id", "n")
    paged = with_hot_columns(events).where("m_has_page")
    by_page = paged.groupBy(hour, F.coalesce("m_page_text", F.lit("unknown")).alias("page")).agg(
        n).select("hour_bucket", F.lit(PAGE).alias("kind"),
                  F.lit(None).cast("int").alias("event_type_id"), "page",
                  F.lit(None).cast("bigint").alias("user_id"), "n")
    return by_user.unionByName(by_page)


def net(*parts: DataFrame) -> DataFrame:
    """Changes added up; what cancels out is gone."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where("n != 0")


def update_changes(before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
    """Changes of the events listed in ``ids`` (id) between two table versions."""
    k = ids.select("id").distinct()
    return net(changes(before.join(k, "id", "left_semi"), -1),
               changes(after.join(k, "id", "left_semi"), 1))


def delete_changes(events: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Changes of deleting the events whose ``key`` is listed."""
    return changes(events.join(keys.select(key).distinct(), key, "left_semi"), -1)


# ---------------------------------------------------------------- recording and applying
def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, p = hadoop_path(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n[len(prefix):] for n in found if n.startswith(prefix))


def _batches(spark: SparkSession, base: str) -> list[tuple[str, int]]:
    """(writer, seq) of the complete batches that wait to be applied."""
    return [(w, int(n)) for w in _names(spark, f"{base}/changes", "writer=")
            for n in _names(spark, f"{base}/changes/writer={w}", "seq=")
            if path_exists(spark, f"{base}/changes/writer={w}/seq={n}/{sinks.SUCCESS}")]


def _ledger(spark: SparkSession, base: str) -> DataFrame:
    path = f"{base}/ledger"
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def last_applied(spark: SparkSession, base: str, writer: str) -> int:
    """The writer's largest batch in any hour: a small row per hour is read."""
    row = _ledger(spark, base).where((F.col("kind") == MARK) & (F.col("page") == writer)).agg(
        F.max("n")).first()
    return row[0] or 0


def record(delta: DataFrame, base: str, seq: int | None = None, writer: str = "batch",
           since=None) -> int:
    """Write a batch's changes; returns its number, counted from 1. A replay
    passes the number it had, which overwrites what a broken attempt left.
    Changes of hours that end by ``since`` (where the lookback begins now, so no
    later rollup asks for them) are left out."""
    spark, base = delta.sparkSession, base.rstrip("/")
    if since is not None:
        delta = delta.where(F.col("hour_bucket") >= ts(floor_hour(since)))
    if seq is None:
        waiting = [n for w, n in _batches(spark, base) if w == writer]
        seq = max([last_applied(spark, base, writer), *waiting]) + 1
    delta.select(*_KEYS, "n").write.mode("overwrite").parquet(
        f"{base}/changes/writer={writer}/seq={seq}")
    return seq


def pending(spark: SparkSession, base: str, batches: list[tuple[str, int]]) -> DataFrame:
    """The recorded changes of some batches, with their writer and number."""
    return (spark.read.schema(CHANGES + ", writer string, seq bigint")
            .option("basePath", f"{base}/changes")
            .parquet(*[f"{base}/changes/writer={w}/seq={n}" for w, n in batches]))


def touched(delta: DataFrame) -> list[str]:
    """The hours that changes touch: one value per hour, not per change."""
    return sorted(r[0] for r in delta.select(hour_key("hour_bucket")).distinct().collect())


def summed(ledger: DataFrame, delta: DataFrame, hours: list[str]) -> DataFrame:
    """The ledger of ``hours`` with the changes that they don't hold yet."""
    delta = delta.withColumn("hour_key", hour_key("hour_bucket"))
    there = ledger.where(F.col("hour_key").isin(hours))
    # a row per touched hour and writer
    marks = there.where(F.col("kind") == MARK).select(
        "hour_key", F.col("page").alias("writer"), F.col("n").alias("upto"))
    new = (delta.join(F.broadcast(marks), ["hour_key", "writer"], "left")
           .where(F.col("seq") > F.coalesce("upto", F.lit(0))))
    kept = ["hour_key", *_KEYS]
    sums = (there.where(F.col("kind") != MARK).select(*kept, "n")
            .unionByName(new.select(*kept, "n"))
            .groupBy(*kept).agg(F.sum("n").alias("n")).where("n != 0"))
    marked = delta.select("hour_key", "hour_bucket", F.col("writer").alias("page"),
                          F.col("seq").alias("n")).distinct()
    marked = (there.where(F.col("kind") == MARK).select(*marked.columns).unionByName(marked)
              .groupBy("hour_key", "hour_bucket", "page").agg(F.max("n").alias("n"))
              .select("hour_key", "hour_bucket", F.lit(MARK).alias("kind"),
                      F.lit(None).cast("int").alias("event_type_id"), "page",
                      F.lit(None).cast("bigint").alias("user_id"), "n"))
    return sums.unionByName(marked).select(*_KEYS, "n", "hour_key")


def hours_of(ledger: DataFrame) -> DataFrame:
    """The rollup rows of a ledger's hours, by type id."""
    t = ledger.where(F.col("kind") == TYPE).groupBy("hour_key", "hour_bucket", "event_type_id").agg(
        F.sum("n").alias("total_count"), F.count_if(F.col("n") > 0).alias("unique_users")).select(
        "hour_bucket", F.lit(TYPE).alias("stat_type"), "event_type_id",
        F.lit(None).cast("string").alias("page"), "total_count", "unique_users",
        F.lit(None).cast("bigint").alias("page_count"), "hour_key")
    p = ledger.where(F.col("kind") == PAGE).select(
        "hour_bucket", F.lit(PAGE).alias("stat_type"), F.lit(None).cast("int")
        .alias("event_type_id"), "page", F.lit(None).cast("bigint").alias("total_count"),
        F.lit(None).cast("bigint").alias("unique_users"), F.col("n").alias("page_count"),
        "hour_key")
    return t.unionByName(p)


def apply(spark: SparkSession, base: str) -> list[str]:
    """Sum the recorded batches into the ledger and the rollup; returns the hours
    that were rewritten. After a failure it is run again: the ledger's marks skip
    what was summed, and the rollup of the touched hours is made anew."""
    base = base.rstrip("/")
    for part in ("ledger", "rollup"):
        sinks.finish_rewrite(spark, f"{base}/{part}")
    batches = _batches(spark, base)
    if not batches:
        return []
    delta = pending(spark, base, batches)
    hours = touched(delta)
    if hours:
        # by range, so that a task writes few hours and a hot hour is cut
        sums = summed(_ledger(spark, base), delta, hours).repartitionByRange(
            "hour_key", *_KEYS[1:])
        sinks.replace_partitions(sums, f"{base}/ledger", "hour_key", hours)
        now = _ledger(spark, base).where(F.col("hour_key").isin(hours))
        sinks.replace_partitions(hours_of(now).repartitionByRange(
            "hour_key", "stat_type", "event_type_id", "page"), f"{base}/rollup", "hour_key", hours)
    for w, n in batches:
        delete_path(spark, f"{base}/changes/writer={w}/seq={n}")
    return hours


def drop_before(spark: SparkSession, base: str, cutoff, events: DataFrame) -> list[str]:
    """Retention (W13): hours wholly before the cutoff go as partitions, unread;
    the cutoff's own hour gives back the ``events`` before it (pass the table
    as it was). Returns the hours that were rewritten."""
    base, c = base.rstrip("/"), parse_ts(cutoff)
    apply(spark, base)
    first = floor_hour(c)
    for part in ("ledger", "rollup"):
        for hour in _names(spark, f"{base}/{part}", "hour_key="):
            if hour < first.strftime("%Y-%m-%dT%H"):
                delete_path(spark, f"{base}/{part}/hour_key={hour}")
    if first == c:
        return []
    gone = events.where((F.col("timestamp") >= ts(first)) & (F.col("timestamp") < ts(c)))
    record(changes(gone, -1), base)
    return apply(spark, base)


# ---------------------------------------------------------------- reading
def current(spark: SparkSession, base: str, event_types: DataFrame, as_of=None,
            lookback_days: int = full.LOOKBACK_DAYS, events: DataFrame | None = None) -> DataFrame:
    """The rollup as a full rebuild at ``as_of`` would give it (A8), from the
    kept hours. Where the lookback begins within an hour, that hour alone is
    counted from ``events`` (needed only then)."""
    lo = lookback_start(parse_ts(as_of) or utcnow(), lookback_days)
    first = floor_hour(lo)
    path = f"{base.rstrip('/')}/rollup"
    kept = (spark.read.schema(HOURS).parquet(path) if path_exists(spark, path)
            else spark.createDataFrame([], HOURS))
    start = first if first == lo else first + dt.timedelta(hours=1)
    kept = kept.where(F.col("hour_key") >= start.strftime("%Y-%m-%dT%H"))
    if first != lo:
        if events is None:
            raise ValueError("the lookback begins within an hour: pass the events")
        part = events.where((F.col("timestamp") >= ts(lo)) & (F.col("timestamp") < ts(start)))
        kept = kept.unionByName(hours_of(changes(part).withColumn(
            "hour_key", hour_key("hour_bucket"))))
    types = kept.where(F.col("stat_type") == TYPE)
    named = with_type_name(types, event_types).select(
        "stat_type", F.col("event_type").alias("key_name"), "hour_bucket", "total_count",
        "unique_users", "page_count")
    pages = kept.where(F.col("stat_type") == PAGE).select(
        "stat_type", F.col("page").alias("key_name"), "hour_bucket", "total_count",
        "unique_users", "page_count")
    return named.unionByName(pages).select(*schemas.ROLLUP.fieldNames())
