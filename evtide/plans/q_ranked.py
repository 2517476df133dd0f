"""Ranks of given members and deep pages from stored ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtide.operators import keyed, ranked, reads
from evtide.plans.oracle import sql
from evtide.plans.q_keyed import BOARDS_SQL, type_boards
from evtide.plans.registry import _BARE, register, _RESPONSE, _t, _TYPED_JOIN
from evtide.session import scratch_path
from evtide.sources import ranges
from evtide.sources.driver_tables import read_driver, stored_snapshot


def _listed(spark, sf_dir):
    """Members to look up: a board and a number for every supplier."""
    s = read_driver(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5 + 1).cast("int").alias("id"),
        F.col("s_suppkey").cast("string").alias("member"))
    return s.join(_t(spark, sf_dir).event_types, "id").select(F.col("name").alias("board"),
                                                              "member")


_LISTED_SQL = """
listed AS (SELECT t.name AS board, CAST(s_suppkey AS VARCHAR) AS member
           FROM supplier JOIN c_event_types t ON t.id = s_nationkey % 5 + 1)"""


@register("leaderboard_ranks_of", sql("""
SELECT board, member, score, rank, reverse_rank FROM ranked
WHERE (board, member) IN (SELECT (board, member) FROM listed)""", BOARDS_SQL + "," + _LISTED_SQL))
def q_leaderboard_ranks_of(spark, sf_dir):
    """Both ranks of listed members from a stored board's order statistics."""
    base = stored_snapshot(spark, sf_dir, "ranked-boards", lambda t, base: ranked.write(
        type_boards(spark, sf_dir), base))
    return ranked.ranks_of(spark, base, _listed(spark, sf_dir))


def _increments(spark, sf_dir):
    """A change of score for every order, some of members not on a board yet."""
    o = read_driver(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("id"),
        (F.col("o_custkey") % 200).cast("string").alias("member"),
        (F.col("o_orderkey") % 7 - 3).cast("double").alias("delta"))
    return o.join(_t(spark, sf_dir).event_types, "id").select(
        F.col("name").alias("board"), "member", "delta")


_INCREMENT_SQL = BOARDS_SQL + """,
changes AS (
  SELECT t.name AS board, CAST(o_custkey % 200 AS VARCHAR) AS member,
         CAST(sum(o_orderkey % 7 - 3) AS DOUBLE) AS delta
  FROM orders JOIN c_event_types t ON t.id = o_orderkey % 5 + 1 GROUP BY 1, 2),
raised AS (
  SELECT board, member, coalesce(score, 0) + coalesce(delta, 0) AS score
  FROM boards FULL JOIN changes USING (board, member))"""


@register("leaderboard_add_scores", sql("SELECT * FROM raised", _INCREMENT_SQL))
def q_leaderboard_add_scores(spark, sf_dir):
    """Increments on boards that exist."""
    return keyed.add_scores(type_boards(spark, sf_dir), _increments(spark, sf_dir))


@register("leaderboard_raised_ranks", sql("""
SELECT board, member, score,
       row_number() OVER (PARTITION BY board ORDER BY score, member) - 1 AS rank,
       row_number() OVER (PARTITION BY board ORDER BY score DESC, member DESC) - 1
         AS reverse_rank
FROM raised""", _INCREMENT_SQL))
def q_leaderboard_raised_ranks(spark, sf_dir):
    """Increments on a stored board, whose ranges and index follow; then the ranks
    of all members."""
    base = scratch_path(spark, "raised-boards")
    ranked.write(type_boards(spark, sf_dir), base)
    ranked.add_scores(spark, base, _increments(spark, sf_dir))
    return ranked.ranks_of(spark, base, ranges.data(spark, base).select("board", "member"))


def _events_by_position(spark, sf_dir) -> str:
    return stored_snapshot(spark, sf_dir, "events-by-position", lambda t, base: ranges.write(
        t.events, base, ["timestamp", "id"]))


def _nine_tenths(spark, base: str) -> int:
    return int((ranges.index(spark, base).agg(F.max("total")).first()[0] or 0) * 9 // 10)


_AT = """placed AS (
  SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) - 1 AS place,
         count(*) OVER () * 9 // 10 AS start FROM c_events)"""


@register("list_events_deep", sql(
    f"SELECT {_RESPONSE} FROM placed e {_TYPED_JOIN} "
    "WHERE place >= start AND place < start + 100", _AT))
def q_list_events_deep(spark, sf_dir):
    """The listing nine tenths down the table (K1), from its position index."""
    base = _events_by_position(spark, sf_dir)
    return reads.list_events_at(spark, base, _t(spark, sf_dir).event_types, limit=100,
                                offset=_nine_tenths(spark, base))


@register("events_page_indexed", sql(
    f"SELECT {_BARE} FROM placed WHERE place >= start + 7 AND place < start + 57", _AT))
def q_events_page_indexed(spark, sf_dir):
    """A bare page far into the events (K3)."""
    base = _events_by_position(spark, sf_dir)
    return reads.bare_event(ranges.page(spark, base, 50, _nine_tenths(spark, base) + 7,
                                        descending=True))


@register("users_page_indexed", sql("""
SELECT id, name, created_at FROM (
  SELECT *, row_number() OVER (ORDER BY name, id) - 1 AS place, count(*) OVER () AS n FROM c_users)
WHERE place >= n * 9 // 10 AND place < n * 9 // 10 + 20"""))
def q_users_page_indexed(spark, sf_dir):
    """A page far into the users by name (K4)."""
    base = stored_snapshot(spark, sf_dir, "users-by-position", lambda t, base: ranges.write(
        t.users, base, ["name", "id"]))
    return reads.user_response(ranges.page(spark, base, 20, _nine_tenths(spark, base)))


@register("list_events_deep_typed", sql(f"""
SELECT {_RESPONSE} FROM (
  SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) - 1 AS place
  FROM c_events WHERE event_type_id = 1) e {_TYPED_JOIN}
WHERE place >= 150 AND place < 190"""))
def q_list_events_deep_typed(spark, sf_dir):
    """The deep form of a filtered listing (K1): positions across partitions."""
    t = _t(spark, sf_dir)
    return reads.list_events(t.events, t.event_types, event_type_id=1, limit=40, offset=150,
                             deep=True)
