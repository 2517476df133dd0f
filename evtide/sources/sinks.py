"""Writers: partitioned appends, CSV exports, versioned snapshots.

A mutation never overwrites the path it reads: each new table version goes to
its own folder, complete once Spark has left its success mark there, and readers
take the newest complete one. A failed job leaves the version before in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.functions.metadata import with_hot_columns, with_variant
from evtide.functions.text import email_from_name
from evtide.functions.timefn import rfc3339, utcnow
from evtide.session import delete_path, hadoop_path, path_exists
from evtide.sources import schemas

SUCCESS = "_SUCCESS"


# ---------------------------------------------------------------- W14, W15
def with_event_date(events: DataFrame) -> DataFrame:
    """Derived partition column ``event_date`` (UTC day of the timestamp)."""
    return events.withColumn("event_date", F.to_date("timestamp"))


def stored_form(events: DataFrame) -> DataFrame:
    """Events as they are stored: with the metadata's hot columns, extracted
    here once, and the day they are partitioned by."""
    return with_event_date(with_hot_columns(events))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A day-partitioned events table in the canonical columns. Days that a rewrite
    under way has emptied are left out, whether or not it has removed them yet."""
    rows = spark.read.parquet(path)
    note = f"{path.rstrip('/')}/{PENDING}"
    if path_exists(spark, note):
        gone = json.loads(_read_note(spark, note))
        if gone["emptied"]:
            rows = rows.where(~F.col(gone["part_col"]).cast("string").isin(
                [n.partition("=")[2] for n in gone["emptied"]]))
    return rows.select(*schemas.EVENTS.fieldNames())


def with_id_filters(writer, column: str = "id"):
    """A Parquet writer that leaves a bloom filter on ``column`` in every row
    group (S4): a lookup by id then opens the row groups that can hold it, as it
    would find its place in an index. About 10 bits an id, up to 1 MB: filters are
    sized by the ids that came (halvings of 1 MB, down to 64 bytes). An expected
    number of ids would fix the size and give a file of a few rows 1 MB as well."""
    return (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option(f"parquet.bloom.filter.candidates.number#{column}", 15))


def append_events(events: DataFrame, path: str, max_records_per_file: int = 5_000_000,
                  num_partitions: int | None = None, variant: bool = False) -> None:
    """Bulk append of events partitioned by ``event_date`` (W14), with the whole
    metadata as a VARIANT column besides the hot columns if asked for.

    Range-partitioned on (event_date, user_id, timestamp): Spark samples the
    bounds, so a day with far more rows than others is cut into many tasks
    (hash-partitioning on the day would put each whole day into one task),
    and every output file holds a contiguous user/time range of one day --
    Parquet min/max statistics then prune user and time predicates, the role
    the reference's user/time indexes play; bloom filters prune lookups by id.
    """
    e = with_event_date(events)
    n = num_partitions or int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range bounds are sampled from the input, so the JSON is parsed after them
    ranged = e.repartitionByRange(n, "event_date", "user_id", "timestamp")
    rows = with_hot_columns(ranged)
    rows = with_variant(rows) if variant else rows
    rows = rows.sortWithinPartitions("event_date", "user_id", "timestamp")
    (with_id_filters(rows.write.mode("append"))
     .partitionBy("event_date").option("maxRecordsPerFile", max_records_per_file).parquet(path))


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Bulk load of a dimension (users, event types)."""
    df.write.mode(mode).parquet(path)


# ---------------------------------------------------------------- W16, W17
def users_export(users: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of the users CSV (W16): id, name, derived email, RFC 3339 time,
    ordered by created_at (id breaks ties), optional limit."""
    out = users.orderBy("created_at", "id")
    if limit is not None:
        out = out.limit(limit)
    return out.select(F.col("id").cast("string").alias("id"), "name",
                      email_from_name("name").alias("email"),
                      rfc3339("created_at").alias("created_at"))


# Fixed values of the event-type export.
TYPE_DESCRIPTION = "Event type description"
TYPE_COUNT_BASE = 99990


def event_types_export(event_types: DataFrame) -> DataFrame:
    """Rows of the event-types CSV (W17): constant description and
    ``99990 + id % 10``, ordered by id."""
    return event_types.orderBy("id").select(
        "id", "name", F.lit(TYPE_DESCRIPTION).alias("description"),
        (F.lit(TYPE_COUNT_BASE) + F.col("id") % 10).alias("count"))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with header and proper quote escaping (W16, W17). One file per
    partition; an ordered export keeps its order across the part files."""
    (df.write.mode("overwrite").option("header", True)
     .option("quoteAll", quote_all).option("escape", '"').csv(path))


# ---------------------------------------------------------------- W18
def versions(spark: SparkSession, base: str) -> list[str]:
    """Complete versions under ``base``, oldest first."""
    fs, p = hadoop_path(spark, base)
    if not fs.exists(p):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(p))
    return [f"{base}/{n}" for n in names
            if n.startswith("v=") and path_exists(spark, f"{base}/{n}/{SUCCESS}")]


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None,
                  keep: int = 2) -> str:
    """Write ``df`` as a new version under ``base``, which makes it current.

    A version is complete once Spark's success mark is in its folder, the last
    thing a write does, so readers switch at one moment. Versions before the
    last ``keep`` are removed; the one that running readers may still use stays.
    """
    base = base.rstrip("/")
    stamp = utcnow().strftime("%Y%m%dT%H%M%S%f")
    path = f"{base}/v={stamp}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    for old in versions(df.sparkSession, base)[:-max(keep, 1)]:
        delete_path(df.sparkSession, old)
    return path


def current_version(spark: SparkSession, base: str) -> str:
    """Path of the newest complete version."""
    found = versions(spark, base.rstrip("/"))
    if not found:
        raise FileNotFoundError(f"no complete version under {base}")
    return found[-1]


def read_current(spark: SparkSession, base: str, schema=None) -> DataFrame:
    """The current version; pass ``schema`` so an empty version reads as an
    empty table instead of failing schema inference."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(current_version(spark, base))


# ---------------------------------------------------------------- partition-scoped rewrite
PENDING = "_pending_rewrite"


def replace_partitions(new_rows: DataFrame, path: str, part_col: str, values: list) -> None:
    """Replace exactly the partitions ``values`` of the Parquet table at
    ``path`` with ``new_rows`` (which hold rows of those partitions only).

    The new rows are written beside the table first (they are usually computed
    from the partitions being replaced), then a note of the rewrite: the staged
    folder, the partitions that get rows and those left empty. From then on the
    rewrite can only go forward: ``finish_rewrite`` swaps the partitions that
    have rows by one dynamic partition overwrite, removes the empty ones and the
    note, and does the same again if an earlier attempt broke off. Untouched
    partitions are never read or written.
    """
    if not values:
        return
    spark, path = new_rows.sparkSession, path.rstrip("/")
    finish_rewrite(spark, path)
    staged = f"{path}/_staged-{uuid.uuid4().hex[:12]}"
    new_rows.write.partitionBy(part_col).parquet(staged)
    fs, p = hadoop_path(spark, staged)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    present = sorted(n for n in names if n.startswith(f"{part_col}="))
    emptied = sorted({f"{part_col}={v}" for v in values} - set(present))
    _write_note(spark, f"{path}/{PENDING}",
                {"staged": staged, "part_col": part_col, "present": present, "emptied": emptied,
                 "schema": new_rows.schema.json()})
    finish_rewrite(spark, path)


def finish_rewrite(spark: SparkSession, path: str) -> bool:
    """Carry a noted rewrite of the table to its end; False if there is none.

    Every step can be repeated, so writers call this before they start, after
    any failure. Readers do not need it once it has returned.
    """
    path = path.rstrip("/")
    note_path = f"{path}/{PENDING}"
    if not path_exists(spark, note_path):
        return False
    note = json.loads(_read_note(spark, note_path))
    if note["present"]:
        from pyspark.sql.types import StructType
        rows = (spark.read.schema(StructType.fromJson(json.loads(note["schema"])))
                .parquet(note["staged"]))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(note["part_col"]).parquet(path))
    for name in note["emptied"]:
        delete_path(spark, f"{path}/{name}")
    delete_path(spark, note_path)
    delete_path(spark, note["staged"])
    return True


def _read_note(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = hadoop_path(spark, path)
    f = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    """Write the note beside its place and rename it there, in one step."""
    fs, tmp = hadoop_path(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(json.dumps(note).encode()))
    finally:
        out.close()
    _, target = hadoop_path(spark, path)
    if not fs.rename(tmp, target):
        raise OSError(f"could not write {path}")


#: Small JSON files that other modules keep beside their tables.
read_note, write_note = _read_note, _write_note
