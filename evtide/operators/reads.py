"""Scans, lookups, projections and paged listings (S*, P*, K1-K7, K12).

Every listing is a top-k (``orderBy(...).limit``) so Spark plans
TakeOrderedAndProject: each task keeps only its best ``offset+limit`` rows and
no full sort of the fact table happens. Sort keys always end in a unique
column so pages are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evtide.functions.params import clamp_limit, resolve_offset
from evtide.functions.timefn import parse_ts, ts
from evtide.functions.text import type_label
from evtide.operators.joins import with_type_name
from evtide.sources import ranges

def newest_first():
    """Sort keys of every event listing: time, then id, both descending."""
    return (F.col("timestamp").desc(), F.col("id").desc())


# ---------------------------------------------------------------- projections
def event_response(df: DataFrame) -> DataFrame:
    """Response projection with the wire names.

    Uses the joined ``event_type`` name when present, else the fallback label
    ``event_type_<id>`` (P3).
    """
    name = F.col("event_type") if "event_type" in df.columns else type_label("event_type_id")
    return df.select(F.col("id"), F.col("user_id").alias("userId"),
                     name.alias("eventType"), F.col("event_type_id"),
                     F.col("timestamp"), F.col("metadata"))


def bare_event(df: DataFrame) -> DataFrame:
    """Bare event projection, no type name."""
    return df.select("id", "user_id", "event_type_id", "timestamp", "metadata")


def user_response(df: DataFrame) -> DataFrame:
    """User projection."""
    return df.select("id", "name", "created_at")


# ---------------------------------------------------------------- filters
def in_range(df: DataFrame, frm=None, to=None, col: str = "timestamp") -> DataFrame:
    """Closed range ``frm <= col <= to`` (P6); either end optional."""
    if frm is not None:
        df = df.filter(F.col(col) >= ts(parse_ts(frm)))
    if to is not None:
        df = df.filter(F.col(col) <= ts(parse_ts(to)))
    return df


def before(df: DataFrame, cutoff, col: str = "timestamp") -> DataFrame:
    """Strictly before."""
    return df.filter(F.col(col) < ts(parse_ts(cutoff)))


def filter_events(events: DataFrame, user_id: int | None = None,
                  event_type_id: int | None = None) -> DataFrame:
    """Optional equality filters combined with AND (P7); None means no filter."""
    if user_id is not None:
        events = events.filter(F.col("user_id") == F.lit(user_id))
    if event_type_id is not None:
        events = events.filter(F.col("event_type_id") == F.lit(event_type_id))
    return events


# ---------------------------------------------------------------- scans
def events_with_types(events: DataFrame, event_types: DataFrame) -> DataFrame:
    """All events with type name, newest first."""
    return event_response(with_type_name(events, event_types)).orderBy(*newest_first())


def users_by_name(users: DataFrame, collation: str | None = None) -> DataFrame:
    """All users by name (S2); id breaks ties.

    Binary (code point) order by default; ``collation="UNICODE"`` (or any
    Spark collation name) sorts like a database's linguistic collation.
    """
    key = F.col("name") if collation is None else F.collate(F.col("name"), collation)
    return user_response(users).orderBy(key, F.col("id"))


def types_by_name(event_types: DataFrame) -> DataFrame:
    """All event types by name (S3)."""
    return event_types.select("id", "name").orderBy("name")


def lookup(df: DataFrame, keys: DataFrame, key: str = "id",
           keys_col: str | None = None) -> DataFrame:
    """Rows whose ``key`` is in ``keys`` (S4, S5, S7): one semi-join, so any
    number of ids costs one scan. The key list is broadcast by Spark only
    when its size allows; a huge key list becomes a shuffle semi-join."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    return df.join(k, key, "left_semi")


#: Keys that are pushed to the scan; more of them are a semi-join.
PUSHED_KEYS = 200


def lookup_few(df: DataFrame, keys: DataFrame, key: str = "id",
               keys_col: str | None = None) -> DataFrame:
    """``lookup`` for a short list of keys: they become literals of the scan, which
    skips the row groups whose statistics or bloom filter (``sinks.with_id_filters``)
    rule them all out. A list longer than ``PUSHED_KEYS`` is a semi-join.

    Each key is an equality of its own: of a long IN list Spark pushes only the
    least and greatest value.
    """
    k = keys.select(F.col(keys_col or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    found = [r[0] for r in k.limit(PUSHED_KEYS + 1).collect()]
    if len(found) > PUSHED_KEYS:
        return lookup(df, keys, key, keys_col)
    cond = F.lit(False)
    for v in found:
        one = F.col(key) == F.lit(v).cast(df.schema[key].dataType)
        cond = one if v == found[0] else cond | one
    return df.filter(cond)


def event_by_id(events: DataFrame, event_types: DataFrame, keys: DataFrame,
                keys_col: str = "id") -> DataFrame:
    """Events by id with type name."""
    return event_response(with_type_name(lookup_few(events, keys, "id", keys_col), event_types))


def find_by_name(df: DataFrame, name: str) -> DataFrame:
    """Exact-name lookup (S6, S8), pushed to the Parquet scan."""
    return df.filter(F.col("name") == F.lit(name))


# ---------------------------------------------------------------- paging
def _page(df: DataFrame, cols: list[str], descending: bool, limit: int | None,
          offset: int, deep: bool = False) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` of ``df`` ordered by ``cols``.

    A page with a limit is a top-k (TakeOrderedAndProject: each task keeps its
    best ``offset + limit`` rows). ``deep`` -- for callers that page far into
    the table -- and an offset without a limit use global positions from range
    partitioning, so no task holds ``offset`` rows. Neither offset nor limit
    is a plain distributed sort.
    """
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in cols]
    if not offset and limit is None:
        return df.orderBy(*order)
    if limit is not None and not deep:
        out = df.orderBy(*order).limit(offset + limit)
        return out.offset(offset) if offset else out
    from evtide.operators.keyed import ordered_positions
    pos = ordered_positions(df, cols, col="_pos", descending=descending)
    keep = F.col("_pos") >= offset
    if limit is not None:
        keep = keep & (F.col("_pos") < offset + limit)
    return pos.filter(keep).orderBy("_pos").drop("_pos")


def _named_page(events: DataFrame, event_types: DataFrame, limit: int | None,
                offset: int, deep: bool = False) -> DataFrame:
    # Top-k on the bare events first, then attach names to the <= limit rows.
    # Equivalent to join-then-top-k because every event's type exists (the
    # foreign key is enforced on ingest and deletes cascade).
    top = _page(bare_event(events), ["timestamp", "id"], True, limit, offset, deep)
    return event_response(with_type_name(top, event_types)).orderBy(*newest_first())


def list_events(events: DataFrame, event_types: DataFrame, user_id: int | None = None,
                event_type_id: int | None = None, limit: int | None = None,
                offset: int | None = None, page: int | None = None,
                deep: bool = False) -> DataFrame:
    """Event listing (K1): filters, newest first, limit default 100 capped at
    1000, offset wins over a 1-based page. ``deep`` for pages far into the
    table, where no task should hold ``offset`` rows; without filters
    ``list_events_at`` is cheaper still."""
    n = clamp_limit(limit)
    off = resolve_offset(offset, page, n)
    return _named_page(filter_events(events, user_id, event_type_id), event_types, n, off, deep)


def list_events_at(spark: SparkSession, base: str, event_types: DataFrame,
                   limit: int | None = None, offset: int | None = None,
                   page: int | None = None) -> DataFrame:
    """The unfiltered listing (K1) of events stored by ``ranges.write`` in
    (timestamp, id) order: only the ranges that hold the page are read."""
    n = clamp_limit(limit)
    top = ranges.page(spark, base, n, resolve_offset(offset, page, n), descending=True)
    return event_response(with_type_name(bare_event(top), event_types)).orderBy(*newest_first())


def user_events(events: DataFrame, event_types: DataFrame, user_id: int,
                limit: int | None = None) -> DataFrame:
    """Events of one user, newest first, optional uncapped limit (K2)."""
    return _named_page(filter_events(events, user_id=user_id), event_types, limit, 0)


def events_page(events: DataFrame, limit: int | None = None,
                offset: int | None = None, deep: bool = False) -> DataFrame:
    """Events by limit/offset, no join (K3); all four combinations, ``deep``
    for pages far into the table."""
    return _page(bare_event(events), ["timestamp", "id"], True, limit, offset or 0, deep)


def users_page(users: DataFrame, limit: int | None = None, offset: int | None = None,
               deep: bool = False, collation: str | None = None) -> DataFrame:
    """Users by name with optional limit/offset (K4), ``deep`` as in K3; names in
    the order of ``collation`` as in S2."""
    u = user_response(users)
    if collation is None:
        return _page(u, ["name", "id"], False, limit, offset or 0, deep)
    keyed = u.withColumn("_name", F.collate(F.col("name"), collation))
    return _page(keyed, ["_name", "id"], False, limit, offset or 0, deep).drop("_name")


def _cursor_page(df: DataFrame, order, limit: int, key_cols: list[str]) -> DataFrame:
    """Top-(limit+1), then mark the page rows and the next cursor.

    The window below runs over at most ``limit+1 <= 1001`` rows (the output of
    the top-k), never over the table.
    """
    top = df.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    ranked = top.withColumn("_rn", F.row_number().over(w))
    more = F.max("_rn").over(Window.partitionBy(F.lit(1))) > limit
    out = ranked.withColumn("_more", more).filter(F.col("_rn") <= limit)
    last = Window.partitionBy(F.lit(1))
    for c in key_cols:
        nxt = F.max_by(F.col(c), F.col("_rn")).over(last)
        out = out.withColumn(f"next_{c}", F.when(F.col("_more"), nxt))
    return out.drop("_rn", "_more")


def events_cursor(events: DataFrame, cursor_ts=None, cursor_id: int | None = None,
                  limit: int = 100, user_id: int | None = None,
                  ties: str = "keep") -> DataFrame:
    """Keyset page of events, newest first (K5; K6 with ``user_id``).

    ``ties="keep"`` (default) pages on (timestamp, id) so rows sharing the
    cursor's timestamp are not lost. ``ties="skip"`` pages on timestamp alone
    with a strict ``<``, which skips such rows. Each row carries
    ``next_timestamp`` / ``next_id``: the cursor of the next page, null on the
    last page. The limit is capped at 1000.
    """
    n = clamp_limit(limit)
    ev = bare_event(filter_events(events, user_id=user_id))
    if cursor_ts is not None:
        c = ts(parse_ts(cursor_ts))
        if ties == "skip" or cursor_id is None:
            ev = ev.filter(F.col("timestamp") < c)
        else:
            ev = ev.filter((F.col("timestamp") < c) |
                           ((F.col("timestamp") == c) & (F.col("id") < F.lit(cursor_id))))
    return _cursor_page(ev, newest_first(), n, ["timestamp", "id"])


def users_cursor(users: DataFrame, cursor_name: str | None = None, limit: int = 100,
                 collation: str | None = None) -> DataFrame:
    """Keyset page of users by name ascending (K7): ``name > cursor``, both in the
    order of ``collation`` if one is given (names that it takes for equal to the
    cursor are behind the page's end, as the cursor is)."""
    n = clamp_limit(limit)
    u = user_response(users)
    name = F.col("name") if collation is None else F.collate(F.col("name"), collation)
    if cursor_name is not None:
        u = u.filter(name > F.lit(cursor_name))
    return _cursor_page(u, (name, F.col("id")), n, ["name"])


def latest_per_user(events: DataFrame, n: int, event_types: DataFrame | None = None
                    ) -> DataFrame:
    """Newest ``n`` events of *every* user at once.

    ``row_number() <= n`` over a per-user window: Spark inserts a partial
    WindowGroupLimit before the shuffle, so even a user holding a third of all
    rows ships at most ``n`` rows per map task.
    """
    if n <= 0:
        return events.limit(0).withColumn("rank", F.lit(0).cast("long"))
    w = Window.partitionBy("user_id").orderBy(*newest_first())
    out = (events.withColumn("rank", F.row_number().over(w).cast("long"))
           .filter(F.col("rank") <= n))
    if event_types is not None:
        out = with_type_name(out, event_types)
    return out
