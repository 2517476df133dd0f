"""Set-based table mutations.

Single-row commands become batch jobs: the input is a DataFrame of commands,
the output is the new version of the table(s) plus a DataFrame that reports
per command what happened (rejects, statuses, missing ids). Nothing is
updated in place; writers store the new version next to the old one
(``evtide.sources.sinks``), so readers never see a half-written table.

Batch semantics: every command is checked against the table *as it was*
before the batch (snapshot semantics). Within a batch, commands carry a
``seq`` column (input order, added when absent); where two commands collide,
the lowest ``seq`` wins.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from evtide.functions.timefn import parse_ts, ts, utc_from_rfc3339, utcnow
from evtide.session import checkpoint_dir


@dataclass(frozen=True)
class Outcome:
    """A new table version and a per-command report."""
    table: DataFrame
    report: DataFrame


def with_seq(df: DataFrame, col: str = "seq") -> DataFrame:
    """Add an input-order column when the batch has none (unique within the
    batch, not dense).

    The numbering is checkpointed to the shared checkpoint folder at once:
    ``monotonically_increasing_id`` depends on the row order inside each
    partition, which a recomputation (a second branch of the plan, a retried
    task after an executor loss) need not reproduce.
    """
    if col in df.columns:
        return df
    checkpoint_dir(df.sparkSession)
    return df.withColumn(col, F.monotonically_increasing_id()).checkpoint(eager=True)


def max_id(df: DataFrame, col: str = "id") -> int:
    """Current largest id (0 for an empty table): one scalar for the driver."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


# ---------------------------------------------------------------- W2
def assign_ids(df: DataFrame, base: int, col: str = "id", stable: bool = False) -> DataFrame:
    """Dense new ids ``base+1 .. base+n`` (W2), BIGSERIAL-style.

    No global window: the batch is checkpointed (stable partitions even if an
    executor is lost), rows are counted per partition, the small per-partition
    count table (one row per partition) gets a running sum, and each row adds
    its position inside its partition, read from
    ``monotonically_increasing_id`` (partition index in the upper bits). Pass
    ``stable`` for rows filtered from a batch that is checkpointed already.
    """
    checkpoint_dir(df.sparkSession)
    rows = df if stable else df.checkpoint(eager=True)
    tagged = rows.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(
            F.spark_partition_id().cast("long"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, not the data
    offsets = counts.select("_pid", (F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offsets = offsets.fillna(0, ["_off"])
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(col, (F.lit(base) + F.col("_off") + F.col("_pos") + 1)
                          .cast("long")).drop("_pid", "_pos", "_off")


# ---------------------------------------------------------------- W1, W3
def ingest_events(records: DataFrame, users: DataFrame, event_types: DataFrame,
                  as_of=None, base_id: int | None = None, events: DataFrame | None = None,
                  id_blocks: str | None = None, owner: str | None = None) -> Outcome:
    """Resolve, validate and number ingest records.

    ``records``: user_id, event_type (name), timestamp (nullable), metadata
    (JSON text, nullable, kept as given). Type names resolve to ids through
    the dimension; a missing (or JSON null) timestamp becomes ``as_of``. Text
    timestamps are RFC 3339 and stored as UTC; text that isn't is rejected as
    ``invalid_timestamp``, as are unknown users and types by their reasons.
    Returns accepted events (canonical schema, new dense ids) and the rejects
    (the record plus ``reason``). Ids are reserved in ``id_blocks``
    (``sources.idblocks``; the first ever follows ``base_id``, an ``owner`` that
    repeats its batch gets its ids again); without it they follow ``base_id``,
    or ``max(events.id)``, which scans that column.
    The judged batch is checkpointed once; ids count its accepted rows.
    """
    as_of = parse_ts(as_of) or utcnow()
    if base_id is None and id_blocks is None:
        base_id = max_id(events) if events is not None else 0
    # numbered in the pass that is checkpointed below, so once and for all
    recs = (records if "seq" in records.columns
            else records.withColumn("seq", F.monotonically_increasing_id()))
    types = event_types.select(F.col("name").alias("event_type"),
                               F.col("id").alias("_type_id"))
    known_users = users.select(F.col("id").alias("user_id"),
                               F.lit(True).alias("_user_ok"))
    at = F.col("timestamp")
    if isinstance(recs.schema["timestamp"].dataType, StringType):
        at = utc_from_rfc3339(at)
    j = (recs.withColumn("_at", at.cast("timestamp_ntz")).join(types, "event_type", "left")
         .join(known_users, "user_id", "left"))
    reason = (F.when(F.col("user_id").isNull(), F.lit("missing_user_id"))
              .when(F.col("event_type").isNull(), F.lit("missing_event_type"))
              .when(F.col("_type_id").isNull(), F.lit("unknown_event_type"))
              .when(F.col("_user_ok").isNull(), F.lit("unknown_user"))
              .when(F.col("timestamp").isNotNull() & F.col("_at").isNull(),
                    F.lit("invalid_timestamp")))
    checkpoint_dir(records.sparkSession)
    j = j.withColumn("reason", reason).checkpoint(eager=True)
    rejects = j.filter(F.col("reason").isNotNull()).select(
        "seq", "user_id", "event_type", "timestamp", "metadata", "reason")
    ok = j.filter(F.col("reason").isNull()).select(
        "seq", "user_id", F.col("_type_id").alias("event_type_id"), "metadata",
        F.coalesce(F.col("_at"), ts(as_of)).alias("timestamp"))
    if id_blocks is not None:
        from evtide.sources import idblocks
        base_id = idblocks.reserve(records.sparkSession, id_blocks, ok.count(), owner,
                                   base_id or 0)
    accepted = assign_ids(ok, base_id, stable=True).select(
        "id", "user_id", "event_type_id", "metadata", "timestamp", "seq")
    return Outcome(accepted, rejects)


# ---------------------------------------------------------------- W4, W5
def name_issue(name, longest: int | None):
    """Why a name can't be stored: missing or longer than ``longest``; else null."""
    c = F.col(name) if isinstance(name, str) else name
    reason = F.when(c.isNull(), F.lit("missing_name"))
    return reason if longest is None else reason.when(F.length(c) > longest,
                                                      F.lit("name_too_long"))


def create_named(batch: DataFrame, table: DataFrame, base_id: int | None = None,
                 defaults: dict | None = None, longest: int | None = None) -> Outcome:
    """Create rows by name unless the name exists (W4 users, W5 types).

    Within the batch the first ``seq`` per name wins (a grouped min, so a hot
    name is pre-aggregated, never collected). Returns created rows with new
    ids plus the report: (seq, name, status), one row per command, with status
    ``created``, ``name_exists``, ``duplicate_in_batch``, ``missing_name`` or
    ``name_too_long`` (more than ``longest`` characters).
    """
    if base_id is None:
        base_id = max_id(table)
    b = with_seq(batch)
    first = b.groupBy("name").agg(F.min("seq").alias("_first"))
    existing = table.select("name").distinct().withColumn("_exists", F.lit(True))
    j = b.join(first, "name", "left").join(existing, "name", "left")
    issue = name_issue("name", longest)
    status = (F.when(issue.isNotNull(), issue)
              .when(F.col("_exists"), F.lit("name_exists"))
              .when(F.col("seq") != F.col("_first"), F.lit("duplicate_in_batch"))
              .otherwise(F.lit("created")))
    rep = j.select("seq", "name", status.alias("status"))
    created = rep.filter(F.col("status") == "created").select("seq", "name")
    for k, v in (defaults or {}).items():
        created = created.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    created = assign_ids(created, base_id)
    return Outcome(created, rep)


# ---------------------------------------------------------------- W6, W7
def update_events(events: DataFrame, updates: DataFrame,
                  event_types: DataFrame) -> Outcome:
    """Apply (event_id, event_type_id?, metadata?) updates.

    A given type replaces the type, a given metadata *replaces* the metadata
    (no merge); null means "not given"; the update's timestamp is ignored.
    Commands for the same event act as if applied in ``seq`` order: the
    event ends with the last given type and the last given metadata of its
    valid commands (a mergeable ``max_by`` per event, so an event with very
    many commands is pre-aggregated, not gathered). Report rows:
    (seq, event_id, status) with ``updated``, ``not_found`` or
    ``unknown_event_type`` (a type id missing from the dimension), plus, on
    ``updated`` rows, the event as it stands after the batch with its
    re-resolved type name ('' when missing, W7).
    """
    u = with_seq(updates)
    ids = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_found"))
    types = event_types.select(F.col("id").alias("_tid"))
    chk = (u.join(ids, "event_id", "left")
           .join(types, F.col("event_type_id") == F.col("_tid"), "left"))
    status = (F.when(F.col("_found").isNull(), F.lit("not_found"))
              .when(F.col("event_type_id").isNotNull() & F.col("_tid").isNull(),
                    F.lit("unknown_event_type"))
              .otherwise(F.lit("updated")))
    chk = chk.withColumn("status", status)
    valid = chk.filter(F.col("status") == "updated")
    good = valid.groupBy(F.col("event_id").alias("id")).agg(
        F.max_by("event_type_id", F.when(F.col("event_type_id").isNotNull(), F.col("seq")))
        .alias("_new_type"),
        F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("seq")))
        .alias("_new_meta"),
        F.lit(True).alias("_hit"))
    e = events.join(good, "id", "left")
    new_events = e.select(
        "id", "user_id",
        F.coalesce("_new_type", "event_type_id").alias("event_type_id"),
        F.when(F.col("_new_meta").isNotNull(), F.col("_new_meta"))
        .otherwise(F.col("metadata")).alias("metadata"),
        "timestamp", F.coalesce("_hit", F.lit(False)).alias("_hit"))
    table = new_events.drop("_hit")
    changed = (new_events.filter("_hit").drop("_hit")
               .join(event_types.select(F.col("id").alias("event_type_id"),
                                        F.col("name").alias("_n")), "event_type_id", "left")
               .withColumn("event_type", F.coalesce("_n", F.lit(""))).drop("_n"))
    # response columns only on commands that were applied
    report = chk.select("seq", "event_id", "status").join(
        changed.withColumnRenamed("id", "event_id").withColumn("status", F.lit("updated")),
        ["event_id", "status"], "left")
    return Outcome(table, report)


# ---------------------------------------------------------------- W8, W9
def rename(table: DataFrame, renames: DataFrame, longest: int | None = None) -> Outcome:
    """Rename rows by id with statuses (W8 users, W9 event types).

    Per command: ``not_found`` when the id is absent; ``name_too_long`` beyond
    ``longest`` characters; ``name_exists`` when another row (different id)
    already has the name, or another id claims it by an earlier command of the
    batch that is itself valid; else ``ok``. A null name is a no-op with
    status ``ok``. The new table applies the ``ok`` renames.
    """
    r = with_seq(renames)
    ids = table.select("id", F.lit(True).alias("_found"))
    t = table.select(F.col("id").alias("_oid"), F.col("name").alias("_oname"))
    clash = r.join(t, (r["name"] == t["_oname"]) & (r["id"] != t["_oid"]), "left_semi") \
        .select("seq", F.lit(True).alias("_clash"))
    too_long = (F.length("name") > longest) if longest is not None else F.lit(False)
    j = r.join(ids, "id", "left").join(clash, "seq", "left")
    claims = j.filter(F.col("_found") & F.col("name").isNotNull() & F.col("_clash").isNull()
                      & ~too_long)
    # the id of the first valid claim owns the name within the batch
    owner = claims.groupBy("name").agg(F.min_by("id", "seq").alias("_owner"))
    j = j.join(owner, "name", "left")
    status = (F.when(F.col("_found").isNull(), F.lit("not_found"))
              .when(F.col("name").isNull(), F.lit("ok"))
              .when(too_long, F.lit("name_too_long"))
              .when(F.col("_clash") | (F.col("id") != F.col("_owner")), F.lit("name_exists"))
              .otherwise(F.lit("ok")))
    rep = j.select("seq", "id", "name", status.alias("status"))
    # commands act in seq order: an id ends with its last ok rename
    applied = (rep.filter((F.col("status") == "ok") & F.col("name").isNotNull())
               .groupBy("id").agg(F.max_by("name", "seq").alias("_new")))
    new = table.join(applied, "id", "left").withColumn(
        "name", F.coalesce("_new", "name")).drop("_new")
    return Outcome(new.select(*table.columns), rep)


# ---------------------------------------------------------------- W10-W12
def delete_by_id(table: DataFrame, ids: DataFrame, key: str = "id",
                 ids_col: str | None = None) -> Outcome:
    """Delete rows by id (W10); report the ids that were not there."""
    k = ids.select(F.col(ids_col or key).alias(key)).distinct()
    kept = table.join(k, key, "left_anti")
    missing = k.join(table.select(key), key, "left_anti")
    return Outcome(kept, missing)


def delete_users_cascade(users: DataFrame, events: DataFrame, ids: DataFrame,
                         ids_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete users and, by the foreign key, their events.

    Returns (users, events, missing ids). Two anti-joins; the id list is
    broadcast by Spark only when it is small.
    """
    k = ids.select(F.col(ids_col).alias("id")).distinct()
    gone = k.join(users.select("id"), "id", "left_semi")
    return (users.join(k, "id", "left_anti"),
            events.join(gone.withColumnRenamed("id", "user_id"), "user_id", "left_anti"),
            k.join(users.select("id"), "id", "left_anti"))


def delete_types_cascade(event_types: DataFrame, events: DataFrame, ids: DataFrame,
                         ids_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete event types and their events (W12): (types, events, missing)."""
    k = ids.select(F.col(ids_col).cast("int").alias("id")).distinct()
    gone = k.join(event_types.select("id"), "id", "left_semi")
    return (event_types.join(k, "id", "left_anti"),
            events.join(gone.withColumnRenamed("id", "event_type_id"), "event_type_id",
                        "left_anti"),
            k.join(event_types.select("id"), "id", "left_anti"))


# ---------------------------------------------------------------- W13
def retention(events: DataFrame, cutoff, date_col: str | None = None) -> Outcome:
    """Delete events strictly before ``cutoff``.

    Returns the kept rows and a one-row report (deleted, cutoff). When the
    table is partitioned by a date column, pass it as ``date_col``: the kept
    side then also carries a partition predicate, so whole older partitions
    are pruned from the scan and only the boundary day is filtered row by row.
    """
    c = parse_ts(cutoff)
    kept = events.filter(F.col("timestamp") >= ts(c))
    gone = events.filter(F.col("timestamp") < ts(c))
    if date_col is not None:
        kept = kept.filter(F.col(date_col) >= F.lit(c.date()))
        gone = gone.filter(F.col(date_col) <= F.lit(c.date()))
    report = gone.agg(F.count(F.lit(1)).alias("deleted")).withColumn("cutoff", ts(c))
    return Outcome(kept, report)


# ---------------------------------------------------------------- in place, by partition
def _key_days(table: DataFrame, keys: DataFrame, key: str, part_col: str) -> DataFrame:
    """(key, day) of every listed key in the table: one scan of two columns,
    checkpointed, from which both the days to rewrite and the missing keys come."""
    checkpoint_dir(table.sparkSession)
    return (table.select(key, part_col).join(keys, key, "left_semi").distinct()
            .checkpoint(eager=True))


def _days_of(found: DataFrame, part_col: str) -> list:
    # at most one value per partition of the table
    return sorted(r[0] for r in found.select(part_col).distinct().collect())


def update_events_in_place(path: str, updates: DataFrame, event_types: DataFrame,
                           part_col: str = "event_date") -> DataFrame:
    """W6 on a day-partitioned events table, rewriting only the days that
    hold an updated id. Returns the per-command report (materialised before
    the table changes). The update never moves a row: the timestamp, and so
    the day, is not updatable."""
    from evtide.sources import schemas, sinks
    spark = updates.sparkSession
    sinks.finish_rewrite(spark, path)
    table = spark.read.parquet(path)
    keys = updates.select(F.col("event_id").alias("id")).distinct()
    days = _days_of(_key_days(table, keys, "id", part_col), part_col)
    scope = table.filter(F.col(part_col).isin(days)).select(*schemas.EVENTS.fieldNames())
    out = update_events(scope, updates, event_types)
    report = out.report.checkpoint(eager=True)
    sinks.replace_partitions(sinks.stored_form(out.table), path, part_col, days)
    return report


def delete_events_in_place(path: str, ids: DataFrame, ids_col: str = "id",
                           part_col: str = "event_date", key: str = "id") -> DataFrame:
    """W10 on a day-partitioned events table: only days holding a row whose
    ``key`` is listed are rewritten; a day that loses all its rows is removed.
    With ``key="user_id"`` this is the event side of the user cascade (W11),
    with ``key="event_type_id"`` of the type cascade (W12). Returns the listed
    keys that matched no row (materialised before the table changes).

    The table's keys are read once, days that hold none of them not at all
    after that."""
    from evtide.sources import sinks
    spark = ids.sparkSession
    sinks.finish_rewrite(spark, path)
    table = spark.read.parquet(path)
    k = ids.select(F.col(ids_col).cast(table.schema[key].dataType).alias(key)).distinct()
    found = _key_days(table, k, key, part_col)
    days = _days_of(found, part_col)
    missing = k.join(found, key, "left_anti").checkpoint(eager=True)
    scope = table.filter(F.col(part_col).isin(days))
    sinks.replace_partitions(scope.join(k, key, "left_anti"), path, part_col, days)
    return missing


def retention_in_place(path: str, cutoff, part_col: str = "event_date",
                       spark: SparkSession | None = None) -> DataFrame:
    """W13 as a physical job on a day-partitioned events table.

    Days wholly before the cutoff are dropped as partitions (no row is read);
    the cutoff's own day, when the cutoff is not at midnight, is rewritten
    with only its rows at or after the cutoff; later days are untouched.
    Returns (deleted, cutoff), counted before anything changes over the days
    up to the cutoff only.
    """
    from evtide.sources import sinks
    spark = spark or SparkSession.builder.getOrCreate()
    sinks.finish_rewrite(spark, path)
    c = parse_ts(cutoff)
    table = spark.read.parquet(path)
    day = F.col(part_col)
    midnight = c == dt.datetime.combine(c.date(), dt.time())
    old = table.filter(day < F.lit(c.date()) if midnight else day <= F.lit(c.date()))
    days = _days_of(old, part_col)
    deleted = retention_scope(old, c).count()
    keep = old.filter((day == F.lit(c.date())) & (F.col("timestamp") >= ts(c)))
    sinks.replace_partitions(keep, path, part_col, days)
    return spark.createDataFrame([(deleted, c)], "deleted long, cutoff timestamp_ntz")


def retention_scope(old: DataFrame, cutoff) -> DataFrame:
    """The rows that retention deletes, out of the days up to the cutoff."""
    return old.filter(F.col("timestamp") < ts(cutoff))
