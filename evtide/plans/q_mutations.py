"""Set-based mutations on command batches built from other driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtide.operators import mutations
from evtide.plans.oracle import sql, tsl
from evtide.plans.registry import AS_OF, ORACLES, register, _t
from evtide.session import scratch_path
from evtide.sources import readers, schemas, sinks
from evtide.sources.driver_tables import read_driver


RETENTION_CUTOFF = "2024-01-15 00:00:00"


def ingest_records(spark, sf_dir) -> DataFrame:
    """Order rows as ingest records (user, type name, optional time, JSON)."""
    o = read_driver(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") * 2).alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "purchase")
        .when(F.col("o_orderstatus") == "O", "view").otherwise("pending").alias("event_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
        .otherwise(F.col("o_orderdate")).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit('{"page":"/orders","product_id":'), F.col("o_orderkey").cast("string"),
                 F.lit("}")).alias("metadata"))


INGEST_SQL = f"""
rec AS (
  SELECT o_custkey * 2 AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'view' ELSE 'pending' END
           AS event_type,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS "timestamp",
         '{{"page":"/orders","product_id":' || CAST(o_orderkey AS VARCHAR) || '}}' AS metadata
  FROM orders),
chk AS (
  SELECT r.*, t.id AS type_id, u.id AS known_user,
    CASE WHEN r.user_id IS NULL THEN 'missing_user_id'
         WHEN r.event_type IS NULL THEN 'missing_event_type'
         WHEN t.id IS NULL THEN 'unknown_event_type'
         WHEN u.id IS NULL THEN 'unknown_user' END AS reason
  FROM rec r LEFT JOIN c_event_types t ON t.name = r.event_type
  LEFT JOIN c_users u ON u.id = r.user_id)"""


def _ingest(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.ingest_events(ingest_records(spark, sf_dir), t.users, t.event_types,
                                   as_of=AS_OF, events=t.events)


@register("ingest_accepted", sql(f"""
SELECT user_id, type_id AS event_type_id, metadata,
       coalesce("timestamp", {tsl(AS_OF)}) AS "timestamp"
FROM chk WHERE reason IS NULL""", INGEST_SQL))
def q_ingest_accepted(spark, sf_dir):
    return _ingest(spark, sf_dir).table.select("user_id", "event_type_id", "metadata",
                                               "timestamp")


@register("ingest_ids", sql("""
SELECT count(*) AS n, (SELECT max(id) FROM c_events) + 1 AS min_id,
       (SELECT max(id) FROM c_events) + count(*) AS max_id, count(*) AS distinct_ids
FROM chk WHERE reason IS NULL""", INGEST_SQL))
def q_ingest_ids(spark, sf_dir):
    return _ingest(spark, sf_dir).table.agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"),
        F.max("id").alias("max_id"), F.countDistinct("id").alias("distinct_ids"))


@register("ingest_ids_reserved", sql("""
SELECT part, CAST(count(*) AS BIGINT) AS n, 1000000001 + part * count(*) AS min_id,
       1000000000 + (part + 1) * count(*) AS max_id, CAST(count(*) AS BIGINT) AS distinct_ids
FROM chk, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) p(part)
WHERE reason IS NULL GROUP BY part""", INGEST_SQL))
def q_ingest_ids_reserved(spark, sf_dir):
    """Two ingests with ids from one folder of reserved blocks, the second one
    run twice under its owner's name (W2); the events aren't asked for theirs."""
    t, blocks = _t(spark, sf_dir), scratch_path(spark, "id-blocks")
    out = None
    for part, owner in ((0, None), (1, "job-2"), (1, "job-2")):
        got = mutations.ingest_events(ingest_records(spark, sf_dir), t.users, t.event_types,
                                      as_of=AS_OF, base_id=10 ** 9, id_blocks=blocks, owner=owner)
        ids = got.table.select(F.lit(part).cast("bigint").alias("part"), "id")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct().groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
        F.countDistinct("id").alias("distinct_ids"))


@register("ingest_rejects", sql(
    'SELECT user_id, event_type, "timestamp", metadata, reason FROM chk '
    'WHERE reason IS NOT NULL', INGEST_SQL))
def q_ingest_rejects(spark, sf_dir):
    return _ingest(spark, sf_dir).report.drop("seq")


def rfc3339_records(spark, sf_dir) -> DataFrame:
    """Order rows as ingest records whose time is text in every form that a
    client may send: UTC, offsets, fractions, none, no zone, no time."""
    o = read_driver(spark, sf_dir, "orders").filter(F.col("o_orderkey").isNotNull())
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = [F.concat(day, F.lit(t)) for t in
             ("T06:30:00Z", "T06:30:00+03:00", "T23:30:00-05:30", "t06:30:00.25z",
              "T06:30:00.123456+00:00")]
    forms += [F.lit(None).cast("string"), F.lit("garbage"), F.concat(day, F.lit("T06:30:00"))]
    form = F.col("o_orderkey") % len(forms)
    at = forms[0]
    for k, f in enumerate(forms[1:], start=1):
        at = F.when(form == k, f).otherwise(at)
    return o.select(
        ((F.col("o_custkey") % 100) + 1).alias("user_id"), F.lit("purchase").alias("event_type"),
        at.alias("timestamp"),
        F.concat(F.lit('{"product_id":'), F.col("o_orderkey").cast("string"), F.lit("}"))
        .alias("metadata"))


RFC3339_SQL = """
rfc AS (
  SELECT (o_custkey % 100) + 1 AS user_id,
         (SELECT id FROM c_event_types WHERE name = 'purchase') AS event_type_id,
         '{"product_id":' || CAST(o_orderkey AS VARCHAR) || '}' AS metadata,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE o_orderkey % 8
           WHEN 0 THEN INTERVAL 390 MINUTE WHEN 1 THEN INTERVAL 210 MINUTE
           WHEN 2 THEN INTERVAL 1740 MINUTE
           WHEN 3 THEN INTERVAL 390 MINUTE + INTERVAL 250 MILLISECOND
           WHEN 4 THEN INTERVAL 390 MINUTE + INTERVAL 123456 MICROSECOND END AS utc,
         CASE WHEN o_orderkey % 8 IN (6, 7) THEN 'invalid_timestamp' END AS reason
  FROM orders)"""


def _ingest_rfc3339(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = scratch_path(spark, "records")
    rfc3339_records(spark, sf_dir).write.json(path)
    return mutations.ingest_events(readers.json_records(spark, path), t.users, t.event_types,
                                   as_of=AS_OF, events=t.events)


@register("ingest_rfc3339", sql(f"""
SELECT user_id, event_type_id, metadata, coalesce(utc, {tsl(AS_OF)}) AS "timestamp"
FROM rfc WHERE reason IS NULL""", RFC3339_SQL))
def q_ingest_rfc3339(spark, sf_dir):
    """JSON records with zoned, fractional and absent times."""
    return _ingest_rfc3339(spark, sf_dir).table.select(
        "user_id", "event_type_id", "metadata", "timestamp")


@register("ingest_rfc3339_rejects", sql(
    "SELECT user_id, metadata, reason FROM rfc WHERE reason IS NOT NULL", RFC3339_SQL))
def q_ingest_rfc3339_rejects(spark, sf_dir):
    """The records whose time is given but is not RFC 3339."""
    return _ingest_rfc3339(spark, sf_dir).report.select("user_id", "metadata", "reason")


def event_updates(spark, sf_dir) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 99)
        .cast("int").alias("event_type_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('{"page":"/checkout"}'))
        .alias("metadata"))


UPDATE_SQL = """
upd AS (
  SELECT o_orderkey AS event_id,
         CAST(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 99 END AS INTEGER)
           AS event_type_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '{"page":"/checkout"}' END AS metadata
  FROM orders),
chk AS (
  SELECT u.*, CASE WHEN e.id IS NULL THEN 'not_found'
                   WHEN u.event_type_id IS NOT NULL AND t.id IS NULL THEN 'unknown_event_type'
                   ELSE 'updated' END AS status
  FROM upd u LEFT JOIN c_events e ON e.id = u.event_id
  LEFT JOIN c_event_types t ON t.id = u.event_type_id)"""


def _update(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.update_events(t.events, event_updates(spark, sf_dir), t.event_types)


@register("update_events", sql("""
SELECT e.id, e.user_id, coalesce(g.event_type_id, e.event_type_id) AS event_type_id,
       coalesce(g.metadata, e.metadata) AS metadata, e."timestamp"
FROM c_events e LEFT JOIN (SELECT * FROM chk WHERE status = 'updated') g
  ON g.event_id = e.id""", UPDATE_SQL))
def q_update_events(spark, sf_dir):
    return _update(spark, sf_dir).table


@register("update_status", sql("""
SELECT c.event_id, c.status, r.user_id, r.event_type_id, r.metadata, r."timestamp",
       r.event_type
FROM chk c LEFT JOIN (
  SELECT g.event_id, e.user_id, coalesce(g.event_type_id, e.event_type_id) AS event_type_id,
         coalesce(g.metadata, e.metadata) AS metadata, e."timestamp",
         coalesce(t.name, '') AS event_type
  FROM chk g JOIN c_events e ON e.id = g.event_id
  LEFT JOIN c_event_types t ON t.id = coalesce(g.event_type_id, e.event_type_id)
  WHERE g.status = 'updated') r
ON r.event_id = c.event_id AND c.status = 'updated'""", UPDATE_SQL))
def q_update_status(spark, sf_dir):
    return _update(spark, sf_dir).report.drop("seq")


def user_renames(spark, sf_dir) -> DataFrame:
    s = read_driver(spark, sf_dir, "supplier")
    return s.select(
        (F.col("s_suppkey") * 15).alias("id"),
        F.when(F.col("s_nationkey") % 3 == 0, F.lit(None))
        .when(F.col("s_nationkey") % 3 == 1,
              F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")))
        .otherwise(F.col("s_name")).alias("name"))


RENAME_SQL = """
ren AS (
  SELECT s_suppkey * 15 AS id,
         CASE s_nationkey % 3 WHEN 0 THEN NULL
              WHEN 1 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
              ELSE s_name END AS name
  FROM supplier),
st AS (
  SELECT r.id, r.name,
    CASE WHEN NOT EXISTS (SELECT 1 FROM c_users u WHERE u.id = r.id) THEN 'not_found'
         WHEN r.name IS NULL THEN 'ok'
         WHEN EXISTS (SELECT 1 FROM c_users u WHERE u.name = r.name AND u.id <> r.id)
           THEN 'name_exists'
         ELSE 'ok' END AS status
  FROM ren r)"""


def _rename(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.rename(t.users, user_renames(spark, sf_dir))


@register("rename_status", sql("SELECT id, name, status FROM st", RENAME_SQL))
def q_rename_status(spark, sf_dir):
    return _rename(spark, sf_dir).report.drop("seq")


@register("rename_users", sql("""
SELECT u.id, coalesce(s.name, u.name) AS name, u.created_at
FROM c_users u LEFT JOIN (SELECT * FROM st WHERE status = 'ok' AND name IS NOT NULL) s
  ON s.id = u.id""", RENAME_SQL))
def q_rename_users(spark, sf_dir):
    return _rename(spark, sf_dir).table


def _debtors(spark, sf_dir) -> DataFrame:
    return read_driver(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("id"))


@register("delete_cascade_events", sql(
    "SELECT * FROM c_events WHERE user_id NOT IN "
    "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def q_delete_cascade_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.delete_users_cascade(t.users, t.events, _debtors(spark, sf_dir))[1]


@register("delete_cascade_users", sql(
    "SELECT * FROM c_users WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def q_delete_cascade_users(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.delete_users_cascade(t.users, t.events, _debtors(spark, sf_dir))[0]


def _fulfilled(spark, sf_dir) -> DataFrame:
    return read_driver(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"))


@register("delete_events_kept", sql(
    "SELECT * FROM c_events WHERE id NOT IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def q_delete_events_kept(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.delete_by_id(t.events, _fulfilled(spark, sf_dir)).table


@register("delete_events_missing", sql(
    "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' "
    "AND o_orderkey NOT IN (SELECT id FROM c_events)"))
def q_delete_events_missing(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.delete_by_id(t.events, _fulfilled(spark, sf_dir)).report


@register("delete_type_cascade", sql(
    "SELECT * FROM c_events WHERE event_type_id NOT IN "
    "(SELECT id FROM c_event_types WHERE name = 'error')"))
def q_delete_type_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    ids = t.event_types.filter(F.col("name") == "error").select("id")
    return mutations.delete_types_cascade(t.event_types, t.events, ids)[1]


@register("retention_keep", sql(
    f'SELECT * FROM c_events WHERE "timestamp" >= {tsl(RETENTION_CUTOFF)}'))
def q_retention_keep(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.retention(t.events, RETENTION_CUTOFF).table


@register("retention_count", sql(
    f'SELECT count(*) AS deleted, {tsl(RETENTION_CUTOFF)} AS cutoff FROM c_events '
    f'WHERE "timestamp" < {tsl(RETENTION_CUTOFF)}'))
def q_retention_count(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mutations.retention(t.events, RETENTION_CUTOFF).report


def new_user_names(spark, sf_dir) -> DataFrame:
    s = read_driver(spark, sf_dir, "supplier")
    first = s.select(F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")))
        .alias("name"))
    again = s.filter(F.col("s_nationkey") < 5).select(F.col("s_name").alias("name"))
    return first.unionByName(again)


CREATE_SQL = """
batch AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN s_name
              ELSE 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS name
  FROM supplier
  UNION ALL SELECT s_name FROM supplier WHERE s_nationkey < 5),
per AS (
  SELECT name, count(*) AS n, name IN (SELECT name FROM c_users) AS ex FROM batch GROUP BY name)"""


@register("create_users_report", sql("""
SELECT name, 'name_exists' AS status, n AS "count" FROM per WHERE ex
UNION ALL SELECT name, 'created', 1 FROM per WHERE NOT ex
UNION ALL SELECT name, 'duplicate_in_batch', n - 1 FROM per WHERE NOT ex AND n > 1""",
                                      CREATE_SQL))
def q_create_users_report(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = mutations.create_named(new_user_names(spark, sf_dir), t.users,
                                 defaults={"created_at": F.lit(AS_OF).cast("timestamp_ntz")})
    return out.report.groupBy("name", "status").agg(F.count(F.lit(1)).alias("count"))


@register("create_users_created", sql(f"""
SELECT count(*) AS n, (SELECT max(id) FROM c_users) + 1 AS min_id,
       (SELECT max(id) FROM c_users) + count(*) AS max_id,
       count(DISTINCT name) AS distinct_names, max({tsl(AS_OF)}) AS created_at
FROM per WHERE NOT ex""", CREATE_SQL))
def q_create_users_created(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = mutations.create_named(new_user_names(spark, sf_dir), t.users,
                                 defaults={"created_at": F.lit(AS_OF).cast("timestamp_ntz")})
    return out.table.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"),
                         F.max("id").alias("max_id"),
                         F.countDistinct("name").alias("distinct_names"),
                         F.max("created_at").alias("created_at"))


@register("create_event_types_report", sql("""
SELECT name, CASE WHEN name IN (SELECT name FROM c_event_types) THEN 'name_exists'
                  ELSE 'created' END AS status, count(*) AS "count"
FROM (SELECT lower(o_orderpriority) AS name FROM orders
      UNION ALL SELECT name FROM c_event_types) b
GROUP BY name HAVING name IN (SELECT name FROM c_event_types)
UNION ALL
SELECT name, 'created', 1 FROM (SELECT DISTINCT lower(o_orderpriority) AS name FROM orders) n
WHERE name NOT IN (SELECT name FROM c_event_types)
UNION ALL
SELECT name, 'duplicate_in_batch', count(*) - 1 FROM (SELECT lower(o_orderpriority) AS name
  FROM orders) d WHERE name NOT IN (SELECT name FROM c_event_types) GROUP BY name
  HAVING count(*) > 1"""))
def q_create_event_types_report(spark, sf_dir):
    """Create event types by name unless present (W5): order priorities and
    the existing type names as the batch."""
    t = _t(spark, sf_dir)
    batch = read_driver(spark, sf_dir, "orders").select(
        F.lower("o_orderpriority").alias("name")).unionByName(t.event_types.select("name"))
    out = mutations.create_named(batch, t.event_types)
    return out.report.groupBy("name", "status").agg(F.count(F.lit(1)).alias("count"))


@register("rename_event_types", sql("""
SELECT CAST(t.id AS BIGINT) AS id, r.name, CASE WHEN r.name IS NULL THEN 'ok'
  WHEN EXISTS (SELECT 1 FROM c_event_types u WHERE u.name = r.name AND u.id <> r.id)
  THEN 'name_exists' ELSE 'ok' END AS status
FROM c_event_types t JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN upper(name)
                                     ELSE (SELECT min(name) FROM c_event_types) END AS name
                           FROM c_event_types) r ON r.id = t.id"""))
def q_rename_event_types(spark, sf_dir):
    """Rename event types (W9): even ids upper-cased, odd ids to the first
    name (a clash except for the row that holds it)."""
    t = _t(spark, sf_dir)
    ren = t.event_types.select(
        F.col("id").cast("long").alias("id"),
        F.when(F.col("id") % 2 == 0, F.upper("name"))
        .otherwise(F.min("name").over(_everything())).alias("name"))
    return mutations.rename(t.event_types.withColumn("id", F.col("id").cast("long")),
                            ren).report.drop("seq")


def _everything():
    from pyspark.sql import Window
    # the window spans the event-type dimension only (a handful of rows)
    return Window.partitionBy(F.lit(1))


@register("retention_partitioned", sql(
    f'SELECT id, user_id, event_type_id, metadata, "timestamp" FROM c_events '
    f'WHERE "timestamp" >= {tsl(RETENTION_CUTOFF)}'))
def q_retention_partitioned(spark, sf_dir):
    """Bulk load partitioned by day (W14), then retention on it (W13): older
    day partitions are pruned from the scan, only the boundary day is
    filtered row by row."""
    path = scratch_path(spark, "events-by-day")
    sinks.append_events(_t(spark, sf_dir).hot, path)
    events = spark.read.parquet(path)
    return mutations.retention(events, RETENTION_CUTOFF, date_col="event_date").table.select(
        *schemas.EVENTS.fieldNames())


@register("delete_cascade", ORACLES["delete_cascade_events"])
def q_delete_cascade(spark, sf_dir):
    """Users in debt deleted; their events go with them."""
    return q_delete_cascade_events(spark, sf_dir)


def _events_by_day(spark, sf_dir) -> str:
    path = scratch_path(spark, "events-by-day")
    sinks.append_events(_t(spark, sf_dir).hot, path)
    return path


@register("update_in_place", ORACLES["update_events"])
def q_update_in_place(spark, sf_dir):
    """W6 applied in place to a day-partitioned copy of the events: only the
    days holding an updated id are rewritten; the whole table is read back."""
    path = _events_by_day(spark, sf_dir)
    mutations.update_events_in_place(path, event_updates(spark, sf_dir),
                                     _t(spark, sf_dir).event_types)
    return sinks.read_events(spark, path)


@register("delete_in_place", ORACLES["delete_events_kept"])
def q_delete_in_place(spark, sf_dir):
    """W10 applied in place to a day-partitioned copy of the events."""
    path = _events_by_day(spark, sf_dir)
    mutations.delete_events_in_place(path, _fulfilled(spark, sf_dir))
    return sinks.read_events(spark, path)


MIDDAY_CUTOFF = "2024-01-15 12:00:00"


@register("retention_in_place", sql(
    f'SELECT id, user_id, event_type_id, metadata, "timestamp" FROM c_events '
    f'WHERE "timestamp" >= {tsl(MIDDAY_CUTOFF)}'))
def q_retention_in_place(spark, sf_dir):
    """W13 as a physical job on a day-partitioned copy: older days dropped as
    partitions, the cutoff day rewritten; the table is read back."""
    path = _events_by_day(spark, sf_dir)
    mutations.retention_in_place(path, MIDDAY_CUTOFF)
    return sinks.read_events(spark, path)


@register("retention_in_place_count", sql(
    f'SELECT count(*) AS deleted, {tsl(MIDDAY_CUTOFF)} AS cutoff FROM c_events '
    f'WHERE "timestamp" < {tsl(MIDDAY_CUTOFF)}'))
def q_retention_in_place_count(spark, sf_dir):
    """The (deleted, cutoff) report of the physical retention job."""
    return mutations.retention_in_place(_events_by_day(spark, sf_dir), MIDDAY_CUTOFF)


@register("delete_cascade_in_place", ORACLES["delete_cascade_events"])
def q_delete_cascade_in_place(spark, sf_dir):
    """Users in debt deleted: their events removed in place from a
    day-partitioned copy, rewriting only the days that held them (W11)."""
    path = _events_by_day(spark, sf_dir)
    t = _t(spark, sf_dir)
    gone = _debtors(spark, sf_dir).join(t.users.select("id"), "id", "left_semi")
    mutations.delete_events_in_place(path, gone, "id", key="user_id")
    return sinks.read_events(spark, path)


def _name_commands(spark, sf_dir) -> DataFrame:
    """Supplier rows as create and rename commands (seq, id, name) that hold
    null, over-long and repeated names, unknown ids and names in use."""
    s = read_driver(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    customer = F.concat(F.lit("Customer#"), F.lpad((k % 7 + 1).cast("string"), 9, "0"))
    name = (F.when(k % 6 == 0, F.lit(None).cast("string"))
            .when(k % 6 == 1, F.repeat(F.lit("x"), 101))
            .when(k % 6 == 2, F.concat(F.lit("new-"), (k % 5).cast("string")))
            .when(k % 6 == 3, customer)
            .when(k % 6 == 4, F.repeat(F.lit("y"), 100))
            .otherwise(F.concat(F.lit("own-"), k.cast("string"))))
    return s.select(k.alias("seq"),
                    F.when(k % 4 == 0, F.lit(10 ** 9) + k).otherwise(k % 40 + 1).alias("id"),
                    name.alias("name"))


_NAME_SQL = """
cmd AS (
  SELECT s_suppkey AS seq,
         CASE WHEN s_suppkey % 4 = 0 THEN 1000000000 + s_suppkey ELSE s_suppkey % 40 + 1 END AS id,
         CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN repeat('x', 101)
           WHEN 2 THEN 'new-' || CAST(s_suppkey % 5 AS VARCHAR)
           WHEN 3 THEN 'Customer#' || lpad(CAST(s_suppkey % 7 + 1 AS VARCHAR), 9, '0')
           WHEN 4 THEN repeat('y', 100) ELSE 'own-' || CAST(s_suppkey AS VARCHAR) END AS name
  FROM supplier)"""


@register("create_names_checked", sql("""
SELECT seq, name, CASE WHEN name IS NULL THEN 'missing_name'
  WHEN length(name) > 100 THEN 'name_too_long'
  WHEN name IN (SELECT name FROM c_users) THEN 'name_exists'
  WHEN EXISTS (SELECT 1 FROM cmd d WHERE d.name = c.name AND d.seq < c.seq)
  THEN 'duplicate_in_batch' ELSE 'created' END AS status FROM cmd c""", _NAME_SQL))
def q_create_names_checked(spark, sf_dir):
    """Create users from commands with null, long, repeated and used names (W4):
    a status for every command."""
    return mutations.create_named(_name_commands(spark, sf_dir).select("seq", "name"),
                                  _t(spark, sf_dir).users,
                                  longest=schemas.USER_NAME_MAX).report


@register("rename_checked", sql("""
SELECT seq, id, name, CASE WHEN NOT known THEN 'not_found' WHEN name IS NULL THEN 'ok'
  WHEN length(name) > 100 THEN 'name_too_long' WHEN clash OR id <> owner THEN 'name_exists'
  ELSE 'ok' END AS status
FROM (SELECT j.*, (SELECT arg_min(d.id, d.seq) FROM j d WHERE d.name = j.name AND d.known
                   AND NOT d.clash AND length(d.name) <= 100) AS owner FROM j) x""", _NAME_SQL + """,
j AS (
  SELECT c.*, c.id IN (SELECT id FROM c_users) AS known,
         EXISTS (SELECT 1 FROM c_users u WHERE u.name = c.name AND u.id <> c.id) AS clash
  FROM cmd c)"""))
def q_rename_checked(spark, sf_dir):
    """Rename users by commands with unknown ids, repeated claims of one name,
    one id twice, null and long names (W8)."""
    return mutations.rename(_t(spark, sf_dir).users, _name_commands(spark, sf_dir),
                            longest=schemas.USER_NAME_MAX).report
