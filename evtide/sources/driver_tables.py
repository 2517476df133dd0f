"""Canonical users / event_types / events built from the driver's tables.

The driver ships a generic ``events`` table (event_id, ts, user_id, event_type,
value, props ``{"k": int}``) and ``customer``. This adapter only reshapes those
rows into the canonical schemas (``evtide.sources.schemas``); it does none of
the analytics. Every operator is then run on the canonical tables and works the
same on any data of that schema.

Adapter rule (the same rule is written as SQL in ``evtide.plans.oracle``):

* event_types: the distinct ``event_type`` names, id = 1-based rank by name.
* users: id = c_custkey, name = c_name, created_at = 2024-01-01 + c_custkey min.
* events: id = event_id, user_id, timestamp = ts, event_type_id from the name,
  metadata = JSON text built from k = props.k:
  - page: absent when k % 7 = 0; JSON null when k % 11 = 0; else "/p/<k % 12>"
  - referrer: REFERRERS[k % 5]
  - session_id: "<user_id>-<yyyy-mm-dd>", but the bare number user_id when
    k % 13 = 0 (a mistyped value, so the strict typed view is null there)
  - product_id: k, only for type "purchase" (k = 0 gives an invalid id)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evtide.functions.metadata import with_hot_columns
from evtide.session import file_state, path_exists, scratch_path
from evtide.sources import schemas
from evtide.sources.sinks import with_id_filters, write_table

# Referrer list of the adapter, indexed by k % 5.
REFERRERS = (
    "https://www.google.com/",
    "https://news.ycombinator.com/",
    "http://blog.example.org/post",
    "android-app://com.example.reader",
    "https://twitter.com/",
)
USERS_EPOCH = "2024-01-01 00:00:00"


@dataclass(frozen=True)
class Tables:
    """``hot`` is ``events`` with the columns extracted from the metadata."""
    users: DataFrame
    event_types: DataFrame
    events: DataFrame
    hot: DataFrame | None = None


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_types_from(raw_events: DataFrame) -> DataFrame:
    # The window runs over the *distinct* names only (the dimension itself,
    # a handful of rows), never over fact rows.
    names = raw_events.select(F.col("event_type").alias("name")).distinct()
    return names.select(
        F.row_number().over(Window.orderBy("name")).cast("int").alias("id"), "name")


def users_from(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.expr(f"timestampadd(MINUTE, c_custkey, TIMESTAMP_NTZ'{USERS_EPOCH}')")
        .alias("created_at"))


def metadata_from(k, user_id, type_name, ts) -> "F.Column":
    page = (F.when(k % 7 == 0, F.lit(""))
            .when(k % 11 == 0, F.lit('"page":null,'))
            .otherwise(F.concat(F.lit('"page":"/p/'), (k % 12).cast("string"), F.lit('",'))))
    ref = F.lit(REFERRERS[0])
    for i, r in enumerate(REFERRERS[1:], start=1):
        ref = F.when(k % 5 == i, F.lit(r)).otherwise(ref)
    session = (F.when(k % 13 == 0,
                      F.concat(F.lit('"session_id":'), user_id.cast("string")))
               .otherwise(F.concat(F.lit('"session_id":"'), user_id.cast("string"), F.lit("-"),
                                   F.to_date(ts).cast("string"), F.lit('"'))))
    product = F.when(type_name == "purchase",
                     F.concat(F.lit(',"product_id":'), k.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("{"), page, F.lit('"referrer":"'), ref, F.lit('",'),
                    session, product, F.lit("}"))


def events_from(raw_events: DataFrame, event_types: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = raw_events.select("event_id", "user_id", "event_type", "ts",
                          k.alias("_k"))
    # Equi-join on the type name; the dimension is tiny and AQE turns this
    # into a broadcast hash join once its real size is known.
    j = e.join(event_types.withColumnRenamed("name", "event_type"), "event_type")
    return j.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("id").alias("event_type_id"),
        metadata_from(F.col("_k"), F.col("user_id"), F.col("event_type"), F.col("ts"))
        .alias("metadata"),
        F.col("ts").alias("timestamp"))


def canonical(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy canonical plans straight over the driver tables (no writes)."""
    raw = read_driver(spark, sf_dir, "events")
    types = event_types_from(raw)
    return Tables(users=users_from(read_driver(spark, sf_dir, "customer")),
                  event_types=types,
                  events=events_from(raw, types))


_STORED: dict[tuple, Tables] = {}
_PATHS: dict[tuple, str] = {}


def _source_key(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir,
            *[file_state(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
              for name in ("events", "customer")])


def stored(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical tables written once per session, then read back.

    The load job (W14/W15) runs the adapter once and stores the tables under
    the shared ``spark.checkpoint.dir``: events range-partitioned and sorted by
    time (Parquet min/max statistics then skip row groups for time-range
    predicates) with the metadata's hot columns, the dimensions as small tables. Every later query reads
    these files, as queries read the event store in production, instead of
    re-deriving the rows.
    """
    key = _source_key(spark, sf_dir)
    if key not in _STORED or not path_exists(spark, f"{_PATHS[key]}/events"):
        t = canonical(spark, sf_dir)
        base = scratch_path(spark, "canonical")
        parts = max(spark.sparkContext.defaultParallelism,
                    int(spark.conf.get("spark.sql.shuffle.partitions")))
        write_table(t.event_types, f"{base}/event_types")
        write_table(t.users, f"{base}/users")
        ordered = t.events.repartitionByRange(parts, "timestamp", "id")
        rows = with_hot_columns(ordered).sortWithinPartitions("timestamp", "id")
        with_id_filters(rows.write).parquet(f"{base}/events")
        hot = spark.read.parquet(f"{base}/events")
        _STORED[key] = Tables(
            users=spark.read.parquet(f"{base}/users"),
            event_types=spark.read.parquet(f"{base}/event_types"),
            events=hot.select(*schemas.EVENTS.fieldNames()), hot=hot)
        _PATHS[key] = base
    return _STORED[key]


_SNAPSHOTS: dict[tuple, str] = {}


def stored_snapshot(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Base folder of the named snapshot of these tables, built on first use by
    ``build(tables, base)``; later readers find the current version there."""
    key = (name, *_source_key(spark, sf_dir))
    if key not in _SNAPSHOTS or not path_exists(spark, _SNAPSHOTS[key]):
        base = scratch_path(spark, name)
        build(stored(spark, sf_dir), base)
        _SNAPSHOTS[key] = base
    return _SNAPSHOTS[key]
