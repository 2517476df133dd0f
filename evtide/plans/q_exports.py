"""Exports, generation, sketches and nested outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtide.functions.timefn import lookback_start, ts
from evtide.operators import keyed, metrics, report, rollup
from evtide.plans.oracle import sql, tsl
from evtide.plans.q_report import HITS_SQL, _report
from evtide.plans.registry import AS_OF, AT, FROM, FROM_H, ORACLES, register, _t, TO, TO_H
from evtide.session import scratch_path
from evtide.sources import generate, readers, sinks
from evtide.sources.driver_tables import read_driver


_USER_ROWS = """
SELECT CAST(id AS VARCHAR) AS id, name,
       lower(replace(name, ' ', '')) || '@example.com' AS email,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at
FROM c_users"""


@register("export_users", sql(_USER_ROWS + " ORDER BY c_users.id LIMIT 100"))
def q_export_users(spark, sf_dir):
    """Rows of the users CSV export (W16) with the optional limit of 100:
    the first by creation time (which follows the id here)."""
    return sinks.users_export(_t(spark, sf_dir).users, limit=100)


@register("export_users_full", sql("""
SELECT CAST(id AS VARCHAR) AS id, name,
       lower(replace(name, ' ', '')) || '@example.com' AS email,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S')
         || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || lpad(CAST(id % 900 + 1 AS VARCHAR), 3, '0')
              ELSE '.' || lpad(CAST((id % 900) * 1000 + 7 AS VARCHAR), 6, '0') END
         || '+00:00' AS created_at
FROM c_users"""))
def q_export_users_full(spark, sf_dir):
    """Rows of the whole users CSV export (W16), of users created at whole
    seconds, milliseconds and microseconds."""
    k = F.col("id") % 900
    micros = (F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, (k + 1) * 1000)
              .otherwise(k * 1000 + 7))
    users = _t(spark, sf_dir).users.withColumn(
        "created_at", F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp"))
                                         + micros).cast("timestamp_ntz"))
    return sinks.users_export(users)


@register("export_event_types", sql(
    "SELECT id, name, 'Event type description' AS description, 99990 + id % 10 AS \"count\" "
    "FROM c_event_types"))
def q_export_event_types(spark, sf_dir):
    """Rows of the event-types CSV export."""
    return sinks.event_types_export(_t(spark, sf_dir).event_types)


@register("generated_profile")
def q_generated_profile(spark, sf_dir):
    """Generate as many events as the driver table holds (G3) for the
    canonical users and types, then profile them per type. Rows-only: the
    values follow Spark's xxhash64."""
    t = _t(spark, sf_dir)
    n = read_driver(spark, sf_dir, "events").count()
    uids = keyed.ordered_positions(t.users.select(F.col("id").alias("user_id")),
                                   ["user_id"], col="idx")
    types = t.event_types.withColumn("page", F.concat(F.lit("/"), F.col("name")))
    gen = generate.events(spark, n, uids, types, as_of=AS_OF)
    return gen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("unique_users"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.count(F.get_json_object("metadata", "$.product_id")).alias("with_product"))


@register("generated_counts", sql("""
SELECT (SELECT name FROM c_event_types WHERE id = i % n_types + 1) AS event_type,
       count(*) AS events, count(DISTINCT i % n_users) AS unique_users, TRUE AS in_span
FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM c_events) - 1)) AS i),
     (SELECT count(*) AS n_types FROM c_event_types), (SELECT count(*) AS n_users FROM c_users)
GROUP BY 1"""))
def q_generated_counts(spark, sf_dir):
    """Generated events (G3) per type: users and types go round in turn, and
    every time lies in the 30 days before the as-of time."""
    t = _t(spark, sf_dir)
    n = read_driver(spark, sf_dir, "events").count()
    uids = keyed.ordered_positions(t.users.select(F.col("id").alias("user_id")),
                                   ["user_id"], col="idx")
    types = t.event_types.withColumn("page", F.lit("/x"))
    gen = generate.events(spark, n, uids, types, as_of=AS_OF)
    start = ts(lookback_start(AS_OF, 30))
    inside = (F.col("timestamp") >= start) & (F.col("timestamp") <= ts(AS_OF))
    return gen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("unique_users"),
        F.bool_and(inside).alias("in_span"))


@register("generated_dimensions", sql(f"""
SELECT 'user' AS kind, i AS id, 'User' || CAST(i AS VARCHAR) AS name, {tsl(AS_OF)} AS created_at
FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM c_users))) AS i)
UNION ALL
SELECT 'round', i, CASE i WHEN 1 THEN '' ELSE '_v' || CAST(i AS VARCHAR) END, NULL
FROM (SELECT unnest(generate_series(1, 3)) AS i)"""))
def q_generated_dimensions(spark, sf_dir):
    """Generated users (G1), as many as there are customers, and the name
    suffixes of generated types (G2) that go three times through the catalogue."""
    n = _t(spark, sf_dir).users.count()
    users = generate.users(spark, n, AS_OF).select(
        F.lit("user").alias("kind"), "id", "name", "created_at")
    size = len(generate.EVENT_CATALOGUE)
    types = generate.event_types(spark, 3 * size)
    rounds = types.groupBy(F.ceil(F.col("id") / size).alias("id")).agg(
        F.countDistinct("name").alias("n"),
        F.min(F.regexp_extract("name", "(_v[0-9]+)?$", 1)).alias("name")).where(
        F.col("n") == size)
    return users.unionByName(rounds.select(
        F.lit("round").alias("kind"), F.col("id").cast("long").alias("id"), "name",
        F.lit(None).cast("timestamp_ntz").alias("created_at")))


@register("sketch_unique_users", sql(f"""
SELECT t.name AS event_type, count(*) AS total_count, TRUE AS within_error
FROM c_events e JOIN c_event_types t ON t.id = e.event_type_id
WHERE date_trunc('hour', e."timestamp") BETWEEN {tsl(FROM_H)} AND {tsl(TO_H)}
GROUP BY GROUPING SETS ((t.name), ())"""))
def q_sketch_unique_users(spark, sf_dir):
    """Distinct users per type, and over all types, for the report range from
    mergeable HLL sketches (A24): the sketch rollup is written as a snapshot
    version, then its hourly sketches are unioned at query time. The estimate
    is compared with the exact count: within 5 %, about three times the
    sketch's standard error."""
    t = _t(spark, sf_dir)
    version = sinks.write_version(rollup.sketch_rollup(t.events, t.event_types, as_of=AS_OF),
                                  scratch_path(spark, "sketch-rollup"))
    sk = spark.read.parquet(version)
    per_type = rollup.sketch_unique_users(sk, FROM_H, TO_H)
    overall = rollup.sketch_unique_users(sk, FROM_H, TO_H, by_type=False).select(
        F.lit(None).cast("string").alias("event_type"), "total_count", "unique_users_est")
    exact = report.exact_unique_users(t.events, t.event_types, FROM, TO, now=AS_OF,
                                      as_of=AS_OF).select(
        F.col("event_type").alias("_type"), F.col("unique_users").alias("_exact"))
    est = per_type.unionByName(overall)
    off = F.abs(F.col("unique_users_est") - F.col("_exact"))
    return est.join(exact, F.col("event_type").eqNullSafe(F.col("_type"))).select(
        "event_type", "total_count", (off <= 0.05 * F.col("_exact")).alias("within_error"))


@register("stats_report_nested", sql(f"""
SELECT 'totals' AS part, 0 AS pos, CAST(NULL AS VARCHAR) AS name, count(*) AS "count",
       count(DISTINCT (slot, what, user_id)) AS unique_users
FROM hits WHERE kind = 'event_type' AND slot BETWEEN {tsl(FROM_H)} AND {tsl(TO_H)}
UNION ALL
SELECT CASE kind WHEN 'page' THEN 'top_pages' ELSE 'event_types' END, place - 1, what, n, NULL
FROM (SELECT kind, what, count(*) AS n, row_number() OVER (
        PARTITION BY kind ORDER BY count(*) DESC, what) AS place
      FROM hits WHERE slot BETWEEN {tsl(FROM_H)} AND {tsl(TO_H)} GROUP BY kind, what) x
WHERE kind = 'event_type' OR place <= 10""", HITS_SQL))
def q_stats_report_nested(spark, sf_dir):
    """The single-row nested report (A13), its arrays laid out as ordered rows."""
    one = report.nested_report(_report(spark, sf_dir, None), FROM, TO, now=AS_OF)
    null = F.lit(None)
    rows = one.select(F.lit("totals").alias("part"), F.lit(0).cast("long").alias("pos"),
                      null.cast("string").alias("name"), F.col("total_events").alias("count"),
                      "unique_users")
    for part, name in (("event_types", "event_type"), ("top_pages", "page")):
        rows = rows.unionByName(one.select(F.posexplode(part).alias("pos", "e")).select(
            F.lit(part).alias("part"), F.col("pos").cast("long").alias("pos"),
            F.col(f"e.{name}").alias("name"), F.col("e.count").alias("count"),
            null.cast("long").alias("unique_users")))
    return rows


@register("realtime_metrics_nested", ORACLES["realtime_metrics"])
def q_realtime_nested(spark, sf_dir):
    """A14 with the type -> count map, the map's entries laid out as rows."""
    t = _t(spark, sf_dir)
    nested = metrics.nested_realtime_metrics(
        metrics.realtime_metrics(t.events, t.event_types, "hour", at=AT))
    return nested.select("bucket_start", "total_events", "unique_users",
                         F.explode("by_type").alias("event_type", "type_count"))


@register("users_csv_roundtrip", sql("""
SELECT CAST(id AS VARCHAR) AS id, name,
       lower(replace(name, ' ', '')) || '@example.com' AS email,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at
FROM c_users"""))
def q_users_csv_roundtrip(spark, sf_dir):
    """Users exported to quoted CSV (W16) and read back with a schema."""
    path = scratch_path(spark, "users-csv")
    sinks.write_csv(sinks.users_export(_t(spark, sf_dir).users), path, quote_all=True)
    return readers.csv_table(spark, path, "id string, name string, email string, "
                                          "created_at string")
