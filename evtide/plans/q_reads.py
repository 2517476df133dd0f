"""Scans, lookups, projections, paging and the metadata views (S*, P*, K1-K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtide.functions.metadata import (
    METADATA, at_path, kind_at, metadata_issue, metadata_text, with_typed_metadata,
)
from evtide.functions.text import category
from evtide.functions.timefn import range_issue
from evtide.operators import metrics, reads
from evtide.operators.keyed import ordered_positions
from evtide.plans.oracle import sql, tsl
from evtide.sources import sinks
from evtide.sources.driver_tables import read_driver, stored_snapshot
from evtide.plans.registry import (
    _BARE,
    LOOKUP_IDS,
    register,
    _RESPONSE,
    _t,
    TYPE,
    _TYPED_JOIN,
    USER,
)


@register("event_by_id", sql(
    f"SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN} "
    f"WHERE e.id IN ({', '.join(map(str, LOOKUP_IDS))})"))
def q_event_by_id(spark, sf_dir):
    t = _t(spark, sf_dir)
    keys = spark.createDataFrame([(i,) for i in LOOKUP_IDS], "id long")
    return reads.event_by_id(t.events, t.event_types, keys)


@register("list_events", sql(
    f'SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN} '
    f'ORDER BY e."timestamp" DESC, e.id DESC LIMIT 100 OFFSET 100'))
def q_list_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.list_events(t.events, t.event_types, page=2)


@register("list_events_filtered", sql(
    f'SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN} '
    f'WHERE e.user_id = {USER} AND e.event_type_id = 1 '
    f'ORDER BY e."timestamp" DESC, e.id DESC LIMIT 5 OFFSET 2'))
def q_list_events_filtered(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.list_events(t.events, t.event_types, user_id=USER, event_type_id=1,
                             limit=5, offset=2, page=7)


@register("user_events", sql(
    f'SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN} WHERE e.user_id = {USER}'))
def q_user_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.user_events(t.events, t.event_types, USER)


@register("user_events_limited", sql(
    f'SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN} WHERE e.user_id = {USER} '
    f'ORDER BY e."timestamp" DESC, e.id DESC LIMIT 7'))
def q_user_events_limited(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.user_events(t.events, t.event_types, USER, limit=7)


@register("events_page", sql(
    f'SELECT {_BARE} FROM c_events ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 20'))
def q_events_page(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.events_page(t.events, limit=50, offset=20)


def _cursor_sql(where: str, limit: int, order: str, keys: list[str], cols: str) -> str:
    nxt = ", ".join(
        f"CASE WHEN max(rn) OVER () > {limit} THEN "
        f"max(CASE WHEN rn = {limit} THEN {k} END) OVER () END AS next_{k.strip(chr(34))}"
        for k in keys)
    return sql(f"""
SELECT {cols}, {nxt} FROM (
  SELECT {cols}, row_number() OVER (ORDER BY {order}) AS rn FROM (
    SELECT {cols} FROM src {where} ORDER BY {order} LIMIT {limit + 1}) a) b
QUALIFY rn <= {limit}""", "src AS (SELECT * FROM c_events)")


CURSOR_TS = "2024-01-20 00:00:00"


@register("events_cursor", _cursor_sql(
    f'WHERE "timestamp" < {tsl(CURSOR_TS)}', 100, '"timestamp" DESC, id DESC',
    ['"timestamp"', "id"], _BARE))
def q_events_cursor(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.events_cursor(t.events, cursor_ts=CURSOR_TS, limit=100, ties="skip")


@register("user_events_cursor", _cursor_sql(
    f'WHERE user_id = {USER} AND "timestamp" < {tsl(CURSOR_TS)}', 10,
    '"timestamp" DESC, id DESC', ['"timestamp"', "id"], _BARE))
def q_user_events_cursor(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.events_cursor(t.events, cursor_ts=CURSOR_TS, limit=10, user_id=USER)


@register("users_page", sql(
    "SELECT id, name, created_at FROM c_users ORDER BY name, id LIMIT 20 OFFSET 10"))
def q_users_page(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.users_page(t.users, limit=20, offset=10)


USERS_CURSOR = "Customer#000000100"


@register("users_cursor", _cursor_sql(
    f"WHERE name > '{USERS_CURSOR}'", 25, "name, id", ["name"],
    "id, name, created_at").replace("src AS (SELECT * FROM c_events)",
                                    "src AS (SELECT * FROM c_users)"))
def q_users_cursor(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.users_cursor(t.users, USERS_CURSOR, 25)


@register("metadata_typed", sql(
    "SELECT id, meta_ok, page, referrer, session_id, product_id FROM c_typed"))
def q_metadata_typed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return with_typed_metadata(t.events, out="m", ok_col="meta_ok").select(
        "id", "meta_ok", "m.page", "m.referrer", "m.session_id", "m.product_id")


_ISSUE_SQL = """CASE
  WHEN referrer IS NOT NULL AND NOT (starts_with(referrer, 'http://')
       OR starts_with(referrer, 'https://')) THEN 'invalid_referrer'
  WHEN product_id IS NOT NULL AND product_id <= 0 THEN 'invalid_product_id' END"""


@register("metadata_invalid", sql(
    f"SELECT id, reason FROM (SELECT id, {_ISSUE_SQL} AS reason FROM c_typed "
    "WHERE meta_ok) x WHERE reason IS NOT NULL"))
def q_metadata_invalid(spark, sf_dir):
    t = _t(spark, sf_dir)
    typed = with_typed_metadata(t.events, out="m")
    return (typed.select("id", metadata_issue("m").alias("reason"))
            .filter(F.col("reason").isNotNull()))


@register("metadata_issue_counts", sql(
    f"SELECT reason, count(*) AS \"count\" FROM (SELECT {_ISSUE_SQL} AS reason FROM c_typed "
    "WHERE meta_ok) x WHERE reason IS NOT NULL GROUP BY reason"))
def q_metadata_issue_counts(spark, sf_dir):
    return q_metadata_invalid(spark, sf_dir).groupBy("reason").agg(
        F.count(F.lit(1)).alias("count"))


@register("events_with_types", sql(f"SELECT {_RESPONSE} FROM c_events e {_TYPED_JOIN}"))
def q_events_with_types(spark, sf_dir):
    """All events with type name, newest first."""
    t = _t(spark, sf_dir)
    return reads.events_with_types(t.events, t.event_types)


@register("users_by_name", sql("SELECT id, name, created_at FROM c_users"))
def q_users_by_name(spark, sf_dir):
    """All users ordered by name."""
    return reads.users_by_name(_t(spark, sf_dir).users)


@register("types_by_name", sql("SELECT id, name FROM c_event_types"))
def q_types_by_name(spark, sf_dir):
    """All event types ordered by name (S3)."""
    return reads.types_by_name(_t(spark, sf_dir).event_types)


@register("user_by_name", sql(
    "SELECT id, name, created_at FROM c_users WHERE name = 'Customer#000000007'"))
def q_user_by_name(spark, sf_dir):
    """Exact-name lookup."""
    return reads.user_response(reads.find_by_name(_t(spark, sf_dir).users, "Customer#000000007"))


@register("type_by_name", sql(f"SELECT id, name FROM c_event_types WHERE name = '{TYPE}'"))
def q_type_by_name(spark, sf_dir):
    """Exact-name lookup of an event type."""
    return reads.find_by_name(_t(spark, sf_dir).event_types, TYPE)


@register("user_by_id", sql(
    "SELECT id, name, created_at FROM c_users WHERE id IN (3, 77, 123456789)"))
def q_user_by_id(spark, sf_dir):
    """Lookup of users by a key list."""
    keys = spark.createDataFrame([(3,), (77,), (123456789,)], "id long")
    return reads.user_response(reads.lookup_few(_t(spark, sf_dir).users, keys))


@register("count_tables", sql("""
SELECT 'events' AS tbl, count(*) AS "count" FROM c_events
UNION ALL SELECT 'users', count(*) FROM c_users
UNION ALL SELECT 'event_types', count(*) FROM c_event_types"""))
def q_count_tables(spark, sf_dir):
    """Row count of each table (A1)."""
    t = _t(spark, sf_dir)
    return (metrics.count_rows(t.events).withColumn("tbl", F.lit("events"))
            .unionByName(metrics.count_rows(t.users).withColumn("tbl", F.lit("users")))
            .unionByName(metrics.count_rows(t.event_types)
                         .withColumn("tbl", F.lit("event_types"))))


@register("event_fallback_labels", sql(
    "SELECT id, user_id AS \"userId\", 'event_type_' || CAST(event_type_id AS VARCHAR) "
    "AS \"eventType\", event_type_id, \"timestamp\", metadata FROM c_events"))
def q_event_fallback_labels(spark, sf_dir):
    """Response projection without the type join: ``event_type_<id>``."""
    return reads.event_response(_t(spark, sf_dir).events)


@register("events_page_deep", sql(
    f'SELECT {_BARE} FROM c_events ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 4000'))
def q_events_page_deep(spark, sf_dir):
    """A page far into the table by global positions (K3)."""
    return reads.events_page(_t(spark, sf_dir).events, limit=50, offset=4000, deep=True)


@register("events_offset_only", sql(
    f'SELECT {_BARE} FROM c_events ORDER BY "timestamp" DESC, id DESC OFFSET 500'))
def q_events_offset_only(spark, sf_dir):
    """All but the newest 500 events, no limit (K3)."""
    return reads.events_page(_t(spark, sf_dir).events, offset=500)


@register("events_cursor_id", _cursor_sql(
    f'WHERE "timestamp" < {tsl(CURSOR_TS)} OR ("timestamp" = {tsl(CURSOR_TS)} AND id < 3000)', 100,
    '"timestamp" DESC, id DESC', ['"timestamp"', "id"], _BARE))
def q_events_cursor_id(spark, sf_dir):
    """Keyset page by the whole cursor (timestamp, id), the default (K5)."""
    return reads.events_cursor(_t(spark, sf_dir).events, cursor_ts=CURSOR_TS + "Z",
                               cursor_id=3000, limit=100)


@register("events_in_order", sql("""
SELECT id, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) - 1 AS pos FROM c_events"""))
def q_events_in_order(spark, sf_dir):
    """Place of every event in the newest-first listing (S1): its order."""
    return ordered_rows(reads.events_with_types(*_events(spark, sf_dir)))


@register("users_in_order", sql(
    "SELECT id, row_number() OVER (ORDER BY name, id) - 1 AS pos FROM c_users"))
def q_users_in_order(spark, sf_dir):
    """Place of every user in the listing by name."""
    return ordered_rows(reads.users_by_name(_t(spark, sf_dir).users))


def _events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.events, t.event_types


def ordered_rows(listing):
    """The rows of a sorted listing with their place in it: partition after
    partition, row after row."""
    at = F.monotonically_increasing_id()
    rows = listing.select("id", at.alias("_at"))
    return ordered_positions(rows, ["_at"], col="pos").drop("_at")


@register("range_checks", sql("""
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate >= l_shipdate
       THEN 'from_not_before_to' END AS issue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""))
def q_range_checks(spark, sf_dir):
    """The rule of report ranges (P13) on a table of them: order to shipping."""
    lines = read_driver(spark, sf_dir, "lineitem").join(
        read_driver(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select("l_orderkey", "l_linenumber",
                        range_issue("o_orderdate", "l_shipdate").alias("issue"))


@register("name_categories", sql("""
SELECT split_part(lower(c_mktsegment) || '.' || c_name || '.x', '.', 1) AS category, count(*) AS n
FROM customer GROUP BY 1"""))
def q_name_categories(spark, sf_dir):
    """Names counted by what is before their first dot."""
    c = read_driver(spark, sf_dir, "customer").select(F.concat_ws(
        ".", F.lower("c_mktsegment"), "c_name", F.lit("x")).alias("name"))
    return c.groupBy(category("name").alias("category")).agg(F.count(F.lit(1)).alias("n"))


_TEXT_SQL = """'{' || concat_ws(',',
  '"page":"' || page || '"', '"referrer":"' || referrer || '"',
  '"session_id":"' || session_id || '"', '"product_id":' || CAST(product_id AS VARCHAR)) || '}'"""


@register("metadata_roundtrip", sql(f"""
SELECT id, {_TEXT_SQL} AS text, page, referrer, session_id, product_id
FROM c_typed WHERE meta_ok"""))
def q_metadata_roundtrip(spark, sf_dir):
    """The typed metadata written as JSON text and read back (F16)."""
    e = with_typed_metadata(_t(spark, sf_dir).events).where("meta IS NOT NULL")
    fields = [f.name for f in METADATA.fields]
    e = e.select("id", metadata_text(**{f: F.col(f"meta.{f}") for f in fields}).alias("text"))
    back = F.from_json("text", METADATA.simpleString())
    return e.select("id", "text", back.alias("b")).select("id", "text", "b.*")


@register("metadata_by_category", sql("""
SELECT e.id, CASE t.name WHEN 'purchase' THEN '{"product_id":' || CAST(e.user_id AS VARCHAR)
                  || ',"amount":' || CAST(e.id % 7 AS VARCHAR) || '}'
             WHEN 'error' THEN '{"code":"e' || CAST(e.id % 5 AS VARCHAR) || '"}'
             ELSE '{"page":"/' || t.name || '"}' END AS text
FROM c_events e JOIN c_event_types t ON t.id = e.event_type_id"""))
def q_metadata_by_category(spark, sf_dir):
    """JSON whose keys differ by the type of the event."""
    t = _t(spark, sf_dir)
    e = reads.with_type_name(t.events, t.event_types)
    kind = F.col("event_type")
    bought, failed = kind == "purchase", kind == "error"
    return e.select("id", metadata_text(
        product_id=F.when(bought, F.col("user_id")), amount=F.when(bought, F.col("id") % 7),
        code=F.when(failed, F.concat(F.lit("e"), (F.col("id") % 5).cast("string"))),
        page=F.when(~bought & ~failed, F.concat(F.lit("/"), kind))).alias("text"))


@register("numeric_sessions", sql("""
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS events,
       count(DISTINCT CAST(metadata ->> '$.session_id' AS BIGINT)) AS sessions
FROM c_events WHERE json_type(metadata, '$.session_id') IN ('BIGINT', 'UBIGINT') GROUP BY 1"""))
def q_numeric_sessions(spark, sf_dir):
    """Sessions whose id is a number, which no hot column keeps: read from the
    stored VARIANT (P5, P9), no JSON is parsed."""
    path = stored_snapshot(spark, sf_dir, "events-variant", lambda t, base: sinks.append_events(
        t.events, f"{base}/events", variant=True))
    e = spark.read.parquet(f"{path}/events").where(kind_at("$.session_id") == "BIGINT")
    return e.groupBy(F.col("event_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(at_path("$.session_id", "bigint")).alias("sessions"))


@register("users_page_collated", sql("""
SELECT id, name, created_at FROM (
  SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS name, created_at FROM c_users)
ORDER BY lower(name), id LIMIT 60 OFFSET 20"""))
def q_users_page_collated(spark, sf_dir):
    """Users by name without regard to case."""
    users = _t(spark, sf_dir).users.withColumn(
        "name", F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    return reads.users_page(users, 60, 20, collation="UTF8_LCASE")
