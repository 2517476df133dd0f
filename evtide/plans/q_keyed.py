"""Boards, lists, sets and registers built from the events (N*, K8-K11, U*, A25-A28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.functions.metadata import json_text
from evtide.operators import keyed, reads
from evtide.plans.oracle import sql, tsl
from evtide.plans.registry import register, _t


def type_boards(spark, sf_dir) -> DataFrame:
    """Boards per event type: every event adds 1 to its user's score."""
    t = _t(spark, sf_dir)
    inc = reads.with_type_name(t.events, t.event_types).select(
        F.col("event_type").alias("board"), F.col("user_id").cast("string").alias("member"),
        F.lit(1.0).alias("delta"))
    return keyed.add_scores(None, inc)


BOARDS_SQL = """
boards AS (
  SELECT t.name AS board, CAST(e.user_id AS VARCHAR) AS member,
         CAST(count(*) AS DOUBLE) AS score
  FROM c_events e JOIN c_event_types t ON e.event_type_id = t.id GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY score, member) - 1 AS rank,
         row_number() OVER (PARTITION BY board ORDER BY score DESC, member DESC) - 1
           AS reverse_rank,
         count(*) OVER (PARTITION BY board) AS size
  FROM boards)"""


@register("leaderboard_scores", sql("SELECT * FROM boards", BOARDS_SQL))
def q_leaderboard_scores(spark, sf_dir):
    return type_boards(spark, sf_dir)


@register("leaderboard_rank", sql(
    "SELECT board, member, score, rank, reverse_rank FROM ranked", BOARDS_SQL))
def q_leaderboard_rank(spark, sf_dir):
    return keyed.with_ranks(type_boards(spark, sf_dir))


@register("leaderboard_top", sql(
    "SELECT board, member, score, reverse_rank AS rank FROM ranked WHERE reverse_rank < 3",
    BOARDS_SQL))
def q_leaderboard_top(spark, sf_dir):
    return keyed.top(type_boards(spark, sf_dir), 3)


@register("leaderboard_range", sql(
    "SELECT board, member, score, rank FROM ranked WHERE rank BETWEEN 0 AND 4", BOARDS_SQL))
def q_leaderboard_range(spark, sf_dir):
    return keyed.rank_range(type_boards(spark, sf_dir), 0, 4)


@register("leaderboard_tail", sql(
    "SELECT board, member, score, reverse_rank AS rank FROM ranked "
    "WHERE reverse_rank >= size - 3", BOARDS_SQL))
def q_leaderboard_tail(spark, sf_dir):
    return keyed.rank_range(type_boards(spark, sf_dir), -3, -1, reverse=True)


@register("score_range", sql("""
SELECT board, member, score, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY score, member) - 1 AS pos
  FROM boards WHERE score BETWEEN 10 AND 14) x WHERE pos >= 1 AND pos < 6""", BOARDS_SQL))
def q_score_range(spark, sf_dir):
    return keyed.score_range(type_boards(spark, sf_dir), 10, 14, offset=1, count=5)


@register("score_count", sql(
    'SELECT board, count(*) AS "count" FROM boards WHERE score BETWEEN 10 AND 14 GROUP BY board',
    BOARDS_SQL))
def q_score_count(spark, sf_dir):
    return keyed.count_by_score(type_boards(spark, sf_dir), 10, 14)


@register("global_rank", sql("""
SELECT CAST(user_id AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score,
       row_number() OVER (ORDER BY count(*), CAST(user_id AS VARCHAR)) - 1 AS rank
FROM c_events GROUP BY user_id"""))
def q_global_rank(spark, sf_dir):
    t = _t(spark, sf_dir)
    inc = t.events.select(F.lit("all").alias("board"),
                          F.col("user_id").cast("string").alias("member"),
                          F.lit(1.0).alias("delta"))
    return keyed.global_rank(keyed.add_scores(None, inc)).drop("board")


@register("recent_activity", sql("""
SELECT id, user_id, event_type_id, metadata, "timestamp", rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, id DESC) AS rank
  FROM c_events) x WHERE rank <= 5"""))
def q_recent_activity(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reads.latest_per_user(t.events, 5)


def user_lists(spark, sf_dir) -> DataFrame:
    """Per user, the type names of their events, newest at the head."""
    t = _t(spark, sf_dir)
    ev = reads.with_type_name(t.events, t.event_types)
    return keyed.list_from(ev, "user_id", "event_type", ["timestamp", "id"], descending=True)


LISTS_SQL = """
lists AS (
  SELECT e.user_id AS key, t.name AS value,
         row_number() OVER (PARTITION BY e.user_id ORDER BY e."timestamp" DESC, e.id DESC) - 1
           AS pos,
         count(*) OVER (PARTITION BY e.user_id) AS size
  FROM c_events e JOIN c_event_types t ON e.event_type_id = t.id)"""


@register("list_range", sql("SELECT key, value, pos FROM lists WHERE pos <= 2", LISTS_SQL))
def q_list_range(spark, sf_dir):
    return keyed.list_range(user_lists(spark, sf_dir), 0, 2)


@register("list_last", sql("SELECT key, value, pos FROM lists WHERE pos = size - 1", LISTS_SQL))
def q_list_last(spark, sf_dir):
    return keyed.list_index(user_lists(spark, sf_dir), -1)


@register("list_pop_right", sql(
    "SELECT key, value, pos FROM lists WHERE pos >= size - 2", LISTS_SQL))
def q_list_pop_right(spark, sf_dir):
    return keyed.list_pop(user_lists(spark, sf_dir), 2, right=True)[0]


@register("list_trim_sizes", sql(
    "SELECT key, count(*) AS size FROM lists WHERE pos BETWEEN 1 AND 10 GROUP BY key",
    LISTS_SQL))
def q_list_trim_sizes(spark, sf_dir):
    trimmed = keyed.list_trim(user_lists(spark, sf_dir), 1, 10)
    return trimmed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


ACTIVE_SQL = """
active AS (
  SELECT DISTINCT 'active:' || CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS key,
         CAST(user_id AS VARCHAR) AS member FROM c_events)"""


DAYS = ["active:2024-01-10", "active:2024-01-11", "active:2024-01-12"]


_DAYS_SQL = ", ".join(f"'{d}'" for d in DAYS)


def _active(spark, sf_dir, days: list[str] | None = None):
    return keyed.daily_active(_t(spark, sf_dir).events, days)


def _days(keys: list[str]) -> list[str]:
    return [k.split(":", 1)[1] for k in keys]


@register("active_users_union", sql(
    f"SELECT DISTINCT member FROM active WHERE key IN ({_DAYS_SQL})", ACTIVE_SQL))
def q_active_union(spark, sf_dir):
    return keyed.set_union(_active(spark, sf_dir, _days(DAYS)), DAYS)


@register("active_users_intersect", sql(
    f"SELECT member FROM active WHERE key IN ({_DAYS_SQL}) GROUP BY member "
    f"HAVING count(DISTINCT key) = {len(DAYS)}", ACTIVE_SQL))
def q_active_intersect(spark, sf_dir):
    return keyed.set_intersect(_active(spark, sf_dir, _days(DAYS)), DAYS)


@register("active_users_diff", sql(
    f"SELECT DISTINCT member FROM active WHERE key = '{DAYS[0]}' AND member NOT IN "
    f"(SELECT member FROM active WHERE key = '{DAYS[1]}')", ACTIVE_SQL))
def q_active_diff(spark, sf_dir):
    return keyed.set_diff(_active(spark, sf_dir, _days(DAYS)), DAYS[0], DAYS[1:2])


@register("active_set_sizes", sql(
    "SELECT key, count(DISTINCT member) AS size FROM active GROUP BY key", ACTIVE_SQL))
def q_active_sizes(spark, sf_dir):
    return keyed.set_sizes(_active(spark, sf_dir))


@register("random_members", sql("""
SELECT key, member FROM active QUALIFY row_number() OVER (
  PARTITION BY key ORDER BY md5('7:' || member), member) <= 3""", ACTIVE_SQL))
def q_random_members(spark, sf_dir):
    """Three reproducible members of every daily active set."""
    return keyed.random_members(_active(spark, sf_dir), 3, seed=7)


def page_writes(spark, sf_dir) -> DataFrame:
    """Each event writes its raw page text to register ``last_page:<user>``."""
    e = _t(spark, sf_dir).events
    return e.select(F.concat(F.lit("last_page:"), F.col("user_id").cast("string")).alias("key"),
                    json_text("metadata", "page").alias("value"),
                    F.col("timestamp").alias("ts"), F.col("id").alias("seq"),
                    F.lit(3 * 86400).alias("ttl_s"))


WRITES_SQL = """
writes AS (
  SELECT 'last_page:' || CAST(user_id AS VARCHAR) AS key,
         json_extract_string(metadata, '$.page') AS value, "timestamp" AS ts, id AS seq
  FROM c_events)"""


@register("latest_per_key", sql(
    "SELECT key, arg_max_null(value, (ts, seq)) AS value, max(ts) AS ts FROM writes GROUP BY key",
    WRITES_SQL))
def q_latest_per_key(spark, sf_dir):
    return keyed.last_write(page_writes(spark, sf_dir))


@register("first_per_key", sql(
    "SELECT key, arg_min_null(value, (ts, seq)) AS value, min(ts) AS ts FROM writes GROUP BY key",
    WRITES_SQL))
def q_first_per_key(spark, sf_dir):
    return keyed.last_write(page_writes(spark, sf_dir), first=True)


UNEXPIRED_AS_OF = "2024-01-28 00:00:00"


@register("unexpired_per_key", sql(f"""
SELECT key, value, ts FROM (
  SELECT key, arg_max_null(value, (ts, seq)) AS value, max(ts) AS ts FROM writes GROUP BY key) x
WHERE ts + INTERVAL 3 DAY > {tsl(UNEXPIRED_AS_OF)}""", WRITES_SQL))
def q_unexpired(spark, sf_dir):
    return keyed.unexpired(page_writes(spark, sf_dir), UNEXPIRED_AS_OF)


@register("field_map", sql("""
SELECT key, field, arg_max_null(value, (ts, seq)) AS value FROM (
  SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, 'page' AS field,
         json_extract_string(metadata, '$.page') AS value, "timestamp" AS ts, id AS seq
  FROM c_events
  UNION ALL
  SELECT 'user:' || CAST(user_id AS VARCHAR), 'referrer',
         json_extract_string(metadata, '$.referrer'), "timestamp", id FROM c_events) w
GROUP BY key, field"""))
def q_field_map(spark, sf_dir):
    e = _t(spark, sf_dir).events
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key")
    w = e.select(key, F.lit("page").alias("field"), json_text("metadata", "page").alias("value"),
                 F.col("timestamp").alias("ts"), F.col("id").alias("seq")).unionByName(
        e.select(key, F.lit("referrer").alias("field"),
                 json_text("metadata", "referrer").alias("value"),
                 F.col("timestamp").alias("ts"), F.col("id").alias("seq")))
    return keyed.field_map(w)


@register("leaderboard_trim", sql("""
SELECT board, member, score FROM ranked WHERE rank > 2""", BOARDS_SQL))
def q_leaderboard_trim(spark, sf_dir):
    """Remove the three lowest-ranked members of every board."""
    return keyed.remove_rank_range(type_boards(spark, sf_dir), 0, 2)


@register("score_remove", sql(
    "SELECT board, member, score FROM boards WHERE NOT (score BETWEEN 10 AND 14)", BOARDS_SQL))
def q_score_remove(spark, sf_dir):
    """Remove members scored in [10, 14]."""
    return keyed.remove_by_score(type_boards(spark, sf_dir), 10, 14)


@register("active_set_edit", sql(f"""
SELECT DISTINCT key, member FROM (
  SELECT key, member FROM active
  WHERE NOT (key = '{DAYS[0]}' AND member IN (SELECT member FROM active WHERE key = '{DAYS[1]}'))
  UNION ALL
  SELECT '{DAYS[0]}', member FROM active WHERE key = '{DAYS[2]}')""", ACTIVE_SQL))
def q_active_set_edit(spark, sf_dir):
    """Set edits (U6): drop from day 1 the members active on day 2, add the
    members of day 3; duplicates collapse."""
    a = _active(spark, sf_dir)
    removes = a.filter(F.col("key") == DAYS[1]).select(F.lit(DAYS[0]).alias("key"), "member")
    adds = a.filter(F.col("key") == DAYS[2]).select(F.lit(DAYS[0]).alias("key"), "member")
    return keyed.set_add(keyed.set_remove(a, removes), adds)


@register("active_set_move", sql(f"""
SELECT DISTINCT CASE WHEN key = '{DAYS[0]}' AND member IN
         (SELECT member FROM active WHERE key = '{DAYS[2]}') THEN 'moved' ELSE key END AS key,
       member
FROM active""", ACTIVE_SQL))
def q_active_set_move(spark, sf_dir):
    """Move members of day 1 that are also active on day 3 into set ``moved``."""
    a = _active(spark, sf_dir)
    moves = a.filter(F.col("key") == DAYS[2]).select(
        F.lit(DAYS[0]).alias("src"), F.lit("moved").alias("dst"), "member")
    return keyed.set_move(a, moves)


@register("leaderboard_bottom", sql(
    "SELECT board, member, score, rank FROM ranked WHERE rank < 3", BOARDS_SQL))
def q_leaderboard_bottom(spark, sf_dir):
    """The three lowest members of every board (K8, bottom form)."""
    return keyed.top(type_boards(spark, sf_dir), 3, bottom=True)


@register("leaderboard_last", sql(
    "SELECT board, member, score, rank FROM ranked WHERE rank BETWEEN size - 4 AND size - 2",
    BOARDS_SQL))
def q_leaderboard_last(spark, sf_dir):
    """Ranks -4 to -2 of every board, both ends from the end."""
    return keyed.rank_range(type_boards(spark, sf_dir), -4, -2)


@register("leaderboard_middle", sql(
    "SELECT board, member, score, rank FROM ranked WHERE rank >= 2 AND rank <= size - 3",
    BOARDS_SQL))
def q_leaderboard_middle(spark, sf_dir):
    """Ranks 2 to -3 of every board, one end from either side."""
    return keyed.rank_range(type_boards(spark, sf_dir), 2, -3)


@register("list_pop_left", sql(
    "SELECT key, value, pos FROM lists WHERE pos < 2", LISTS_SQL))
def q_list_pop_left(spark, sf_dir):
    """The two elements popped from the head of every list."""
    return keyed.list_pop(user_lists(spark, sf_dir), 2)[0]


@register("list_pop_rest", sql(
    "SELECT key, value, pos - 2 AS pos FROM lists WHERE pos >= 2", LISTS_SQL))
def q_list_pop_rest(spark, sf_dir):
    """What is left after the pop, renumbered from 0."""
    return keyed.list_pop(user_lists(spark, sf_dir), 2)[1].drop("size")


@register("list_middle", sql(
    "SELECT key, value, pos FROM lists WHERE pos >= 1 AND pos <= size - 3", LISTS_SQL))
def q_list_middle(spark, sf_dir):
    """Positions 1 to -3 of every list."""
    return keyed.list_range(user_lists(spark, sf_dir), 1, -3)


@register("null_keys", sql("""
SELECT key, value, pos, size FROM (
  SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS key, id AS value,
         row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END
                            ORDER BY id) - 1 AS pos,
         count(*) OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END)
           AS size
  FROM c_events) x"""))
def q_null_keys(spark, sf_dir):
    """Lists where a third of all rows have a null key: a list like any other."""
    e = _t(spark, sf_dir).events.select(
        F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3).alias("k"), "id")
    return keyed.list_from(e.withColumn("value", F.col("id")), "k", "value", ["id"])


@register("set_move_twice", sql(f"""
SELECT DISTINCT CASE WHEN a.key = '{DAYS[0]}' THEN 'first' ELSE a.key END AS key, a.member
FROM active a""", ACTIVE_SQL))
def q_set_move_twice(spark, sf_dir):
    """Every member of day 1 is moved twice; the lower seq wins."""
    a = _active(spark, sf_dir)
    day = a.filter(F.col("key") == DAYS[0]).select(F.lit(DAYS[0]).alias("src"), "member")
    moves = day.withColumn("dst", F.lit("second")).withColumn("seq", F.lit(2)).unionByName(
        day.withColumn("dst", F.lit("first")).withColumn("seq", F.lit(1)))
    return keyed.set_move(a, moves)


def _null_board(spark, sf_dir) -> DataFrame:
    """A board with null boards, members and scores."""
    e = _t(spark, sf_dir).events.groupBy(
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")))
        .alias("board"),
        F.when(F.col("event_type_id") != 2, F.col("user_id").cast("string")).alias("member")).agg(
        F.count(F.lit(1)).cast("double").alias("score"))
    return e.withColumn("score", F.when(F.coalesce(F.col("member"), F.lit("3")) != "3",
                                        F.col("score")))


NULL_BOARD_SQL = """
nb AS (
  SELECT board, member, CASE WHEN coalesce(member, '3') <> '3' THEN score END AS score FROM (
    SELECT CASE WHEN user_id % 4 <> 0 THEN 'b' || CAST(user_id % 3 AS VARCHAR) END AS board,
           CASE WHEN event_type_id <> 2 THEN CAST(user_id AS VARCHAR) END AS member,
           CAST(count(*) AS DOUBLE) AS score FROM c_events GROUP BY 1, 2) x)"""


@register("null_board_scores", sql("""
SELECT n.board, n.member, CASE WHEN i.delta IS NULL THEN n.score
                               ELSE coalesce(n.score, 0) + i.delta END AS score
FROM nb n LEFT JOIN (
  SELECT board, member, 2.5 AS delta FROM nb WHERE board IS NULL OR member IS NULL) i
  ON n.board IS NOT DISTINCT FROM i.board AND n.member IS NOT DISTINCT FROM i.member
UNION ALL SELECT NULL, 'new', 1.0""", NULL_BOARD_SQL))
def q_null_board_scores(spark, sf_dir):
    """Increments of null boards and members, which are members like others."""
    board = _null_board(spark, sf_dir)
    inc = board.where("board IS NULL OR member IS NULL").select(
        "board", "member", F.lit(2.5).alias("delta"))
    one = spark.createDataFrame([(None, "new", 1.0)], "board string, member string, delta double")
    return keyed.add_scores(board, inc.unionByName(one))


@register("null_board_remove", sql(
    "SELECT board, member, score FROM nb WHERE score IS NULL OR score NOT BETWEEN 1 AND 3",
    NULL_BOARD_SQL))
def q_null_board_remove(spark, sf_dir):
    """A null score lies in no range and stays."""
    return keyed.remove_by_score(_null_board(spark, sf_dir), 1, 3)


def _null_sets(spark, sf_dir) -> DataFrame:
    return _null_board(spark, sf_dir).select(F.col("board").alias("key"), "member").distinct()


@register("null_set_edits", sql("""
SELECT DISTINCT 'kept' AS part, board AS key, member FROM nb
WHERE board IS NOT NULL AND member IS NOT NULL
UNION ALL SELECT DISTINCT 'moved', CASE WHEN board IS NULL THEN 'b9' WHEN board = 'b1' THEN NULL
                                        ELSE board END, member FROM nb
UNION ALL SELECT DISTINCT 'diff', NULL, member FROM nb a WHERE board = 'b0' AND NOT EXISTS (
  SELECT 1 FROM nb b WHERE b.board = 'b1' AND b.member IS NOT DISTINCT FROM a.member)""",
    NULL_BOARD_SQL))
def q_null_set_edits(spark, sf_dir):
    """Null keys and members removed, moved and taken off."""
    sets = _null_sets(spark, sf_dir)
    gone = sets.where("key IS NULL OR member IS NULL")
    moves = sets.select(F.col("key").alias("src"), "member").where(
        "src IS NULL OR src = 'b1'").withColumn(
        "dst", F.when(F.col("src").isNull(), F.lit("b9")))
    parts = (("kept", keyed.set_remove(sets, gone)), ("moved", keyed.set_move(sets, moves)),
             ("diff", keyed.set_diff(sets, "b0", ["b1"]).withColumn(
                 "key", F.lit(None).cast("string"))))
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("part"), "key", "member")
        out = rows if out is None else out.unionByName(rows)
    return out
