"""Canonical table schemas (explicit; nothing is inferred).

Timestamps are ``TIMESTAMP_NTZ`` holding UTC wall-clock time: hour buckets and
day boundaries then never depend on a session zone, and the values compare
one-to-one with naive timestamps in Parquet written by other engines.
"""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

EVENT_TYPES = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("event_type_id", T.IntegerType(), False),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])

# Typed view of the metadata JSON.
METADATA = T.StructType([
    T.StructField("page", T.StringType(), True),
    T.StructField("referrer", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("product_id", T.IntegerType(), True),
])

# Longest names of users and event types, in characters.
USER_NAME_MAX = 100
TYPE_NAME_MAX = 255

# One ingest command (JSON record or stream row). ``metadata`` is raw JSON text,
# ``timestamp`` RFC 3339 text, so that a bad time is told from a missing one.
INGEST_RECORD = T.StructType([
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
])

EVENT_UPDATE = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("event_type_id", T.IntegerType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),  # accepted, ignored
])

RENAME = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
])

ROLLUP = T.StructType([
    T.StructField("stat_type", T.StringType(), False),
    T.StructField("key_name", T.StringType(), True),
    T.StructField("hour_bucket", T.TimestampNTZType(), True),
    T.StructField("total_count", T.LongType(), True),
    T.StructField("unique_users", T.LongType(), True),
    T.StructField("page_count", T.LongType(), True),
])

REPORT = T.StructType([
    T.StructField("result_type", T.StringType(), False),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("count", T.LongType(), True),
    T.StructField("unique_users", T.LongType(), True),
    T.StructField("page", T.StringType(), True),
])

# Keyed structures: sets, sorted sets (boards), lists, logs. A null key, member
# or score is a value of its own.
KEYED_SET = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("member", T.StringType(), True),
])
BOARD = T.StructType([
    T.StructField("board", T.StringType(), True),
    T.StructField("member", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
])
LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType()), True),
])
