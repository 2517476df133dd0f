"""Keyed structures as tables: sorted sets (boards), lists, sets, registers.

The reference keeps these as single-key structures in a key-value store. Here
each is a table with a key column, and every operation is a set-based job
over *all* keys at once:

* board:  (board, member, score)   -- sorted set
* list:   (key, pos, value)        -- pos 0 is the head (left end)
* set:    (key, member)
* writes: (key, value, ts, seq)    -- register history; last write wins

A null key, member or score is a value like any other: nulls are equal, sort first
and lie in no range.

Ranks follow sorted-set order: ascending by (score, member); reverse order is
descending on both. Ranks and positions are 0-based; negative indexes count
from the end (-1 is the last).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtide.functions.timefn import parse_ts, ts
from evtide.operators.running import running


def _asc():
    return (F.col("score").asc(), F.col("member").asc())


def _desc():
    return (F.col("score").desc(), F.col("member").desc())


# ---------------------------------------------------------------- scores
def add_scores(board: DataFrame | None, increments: DataFrame) -> DataFrame:
    """Score counters (A26): add ``delta`` to each (board, member).

    Increments are summed per member first (map-side partial aggregation),
    then full-outer joined to the current scores; members new to a board
    start from 0.
    """
    inc = increments.groupBy("board", "member").agg(F.sum("delta").alias("_inc"))
    if board is None:
        return inc.select("board", "member", F.col("_inc").cast("double").alias("score"))
    # one row per member on either side, so both are added up by a union, which
    # treats nulls as equal; a score without increments stays what it is
    rows = board.select("board", "member", F.col("score").cast("double").alias("_s"),
                        F.lit(None).cast("double").alias("_i"), F.lit(1).alias("_there"))
    more = inc.select("board", "member", F.lit(None).cast("double").alias("_s"),
                      F.col("_inc").cast("double").alias("_i"), F.lit(0).alias("_there"))
    j = rows.unionByName(more).groupBy("board", "member").agg(
        F.max("_s").alias("_s"), F.max("_i").alias("_i"), F.max("_there").alias("_there"))
    return j.select("board", "member", F.when(F.col("_i").isNull() & (F.col("_there") == 1),
                                              F.col("_s"))
                    .otherwise(F.coalesce("_s", F.lit(0.0)) + F.coalesce("_i", F.lit(0.0)))
                    .alias("score"))


# ---------------------------------------------------------------- N1-N4, K8-K10
def with_ranks(board: DataFrame) -> DataFrame:
    """0-based rank and reverse rank of every member in its board.

    Ranks and board sizes both come from ``ordered_positions`` (no per-board
    window, no shuffle on the board); the reverse order is the exact mirror of
    (score, member), so reverse_rank = size - 1 - rank.
    """
    r = ordered_positions(board, ["score", "member"], col="rank", group="board",
                          size_col="_size")
    return r.withColumn("reverse_rank", F.col("_size") - 1 - F.col("rank")).drop("_size")


def _bounds(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """First and last index of [start, stop], negatives from the end."""
    lo = F.lit(start) if start >= 0 else F.greatest(size + F.lit(start), F.lit(0))
    return lo, F.lit(stop) if stop >= 0 else size + F.lit(stop)


def rank_range(board: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by rank in [start, stop], inclusive, negatives from the end.

    Two ends on the same side are the first (or last) rows of each board:
    ``row_number() <= n`` cuts every board to n rows per task before the
    shuffle. An end on either side needs every position, taken from
    ``ordered_positions`` together with the board's size.
    """
    if start >= 0 and stop >= 0:
        return _first_ranks(board, start, stop, not reverse)
    if start < 0 and stop < 0:
        near = _first_ranks(board, -stop - 1, -start - 1, reverse)
        sizes = board.groupBy(F.col("board").alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
        # only the few rows kept meet the sizes
        return (near.join(sizes, F.col("board").eqNullSafe(F.col("_b")))
                .withColumn("rank", F.col("_size") - 1 - F.col("rank")).drop("_b", "_size"))
    r = ordered_positions(board, ["score", "member"], col="rank", descending=reverse,
                          group="board", size_col="_size")
    lo, hi = _bounds(start, stop, F.col("_size"))
    return r.filter((F.col("rank") >= lo) & (F.col("rank") <= hi)).drop("_size")


def _first_ranks(board: DataFrame, start: int, stop: int, ascending: bool) -> DataFrame:
    r = _first_rows(board, stop + 1, ascending).withColumn(
        "rank", (F.col("_rn") - 1).cast("long"))
    return r.filter(F.col("rank") >= start).drop("_rn")


def _first_rows(board: DataFrame, n: int, ascending: bool) -> DataFrame:
    """The first n members of every board, numbered from 1 in ``_rn``. The bare
    ``row_number() <= n`` is what Spark turns into a limit per task."""
    w = Window.partitionBy("board").orderBy(*(_asc() if ascending else _desc()))
    return board.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def remove_rank_range(board: DataFrame, start: int, stop: int) -> DataFrame:
    """The board without the members of rank [start, stop]."""
    gone = rank_range(board, start, stop).select(F.col("board").alias("_b"),
                                                 F.col("member").alias("_m"))
    return board.join(gone, F.col("board").eqNullSafe(F.col("_b"))
                      & F.col("member").eqNullSafe(F.col("_m")), "left_anti")


def top(board: DataFrame, n: int, bottom: bool = False) -> DataFrame:
    """Top-n (highest first) or bottom-n of every board (K8); n=0 is empty.

    ``row_number() <= n`` lets Spark cut each board to n rows per map task
    (WindowGroupLimit) before the shuffle.
    """
    if n <= 0:
        return board.limit(0).withColumn("rank", F.lit(0).cast("long"))
    return _first_rows(board, n, bottom).withColumn(
        "rank", (F.col("_rn") - 1).cast("long")).drop("_rn")


def score_range(board: DataFrame, lo: float, hi: float, offset: int = 0,
                count: int | None = None) -> DataFrame:
    """Members with lo <= score <= hi in ascending order, optional offset and
    count per board (K9); ``pos`` is the position inside the range.

    With a count the range is the first ``offset + count`` members of each
    board (cut per task before the shuffle); without one, every position.
    """
    inside = board.filter(F.col("score").between(lo, hi))
    if count is not None:
        r = _first_rows(inside, offset + count, True)
        return r.filter(F.col("_rn") > offset).withColumn(
            "pos", (F.col("_rn") - 1).cast("long")).drop("_rn")
    r = ordered_positions(inside, ["score", "member"], col="pos", group="board")
    return r.filter(F.col("pos") >= offset) if offset else r


def count_by_score(board: DataFrame, lo: float, hi: float) -> DataFrame:
    """Members per board with lo <= score <= hi."""
    return (board.filter(F.col("score").between(lo, hi))
            .groupBy("board").agg(F.count(F.lit(1)).alias("count")))


def remove_by_score(board: DataFrame, lo: float, hi: float) -> DataFrame:
    """The board without members scored in [lo, hi] (K10); a null score is in no
    range and stays."""
    return board.filter(~F.coalesce(F.col("score").between(lo, hi), F.lit(False)))


def ordered_positions(df: DataFrame, order: list[str], num_partitions: int | None = None,
                      col: str = "pos", descending: bool = False,
                      group: str | None = None, size_col: str | None = None) -> DataFrame:
    """0-based position of every row in ``order`` -- globally, or inside each
    ``group`` -- without a window over a whole group (N7).

    One range exchange on (group, order) cuts a big group into many partitions;
    the first group of a partition goes on where the partitions before left it
    (``operators.running``). ``size_col`` is the group's size. A null group is a
    group.
    """
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return running(df, [group] if group else [], keys, position=col, size=size_col,
                   num_partitions=num_partitions)


def board_ranks(board: DataFrame, reverse: bool = False, col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """0-based rank of every member within its board, skew-proof."""
    return ordered_positions(board, ["score", "member"], num_partitions, col,
                             descending=reverse, group="board")


def global_rank(board: DataFrame, num_partitions: int | None = None,
                reverse: bool = False) -> DataFrame:
    """Rank on one board of any size (N7): (board, member, score, rank)."""
    return board_ranks(board, reverse, "rank", num_partitions)


# ---------------------------------------------------------------- lists
def list_from(df: DataFrame, key: str, value: str, order: list[str],
              descending: bool = False) -> DataFrame:
    """Build lists (key, value, pos, size): rows of each key in ``order`` become
    positions 0..n-1 (grouped positions, so one huge list is still spread over
    many tasks). The size travels with the rows, so that every later operation
    on either end is a filter."""
    src = df.select(F.col(key).alias("key"), F.col(value).alias("value"), *order)
    return ordered_positions(src, order, col="pos", descending=descending,
                             group="key", size_col="size").drop(*order)


def _sized(lists: DataFrame) -> DataFrame:
    """Lists with their size; lists made elsewhere get it by a grouped maximum."""
    if "size" in lists.columns:
        return lists
    sizes = lists.groupBy(F.col("key").alias("_k")).agg((F.max("pos") + 1).alias("size"))
    return lists.join(sizes, F.col("key").eqNullSafe(F.col("_k"))).drop("_k")


def list_range(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements at positions [start, stop] inclusive, negatives from the end."""
    d = lists if start >= 0 and stop >= 0 else _sized(lists)
    lo, hi = _bounds(start, stop, F.col("size"))
    return d.filter((F.col("pos") >= lo) & (F.col("pos") <= hi)).drop("size")


def list_index(lists: DataFrame, index: int) -> DataFrame:
    """The element at ``index`` of every list (N5); none where the list is shorter."""
    return list_range(lists, index, index) if index >= 0 else _sized(lists).filter(
        F.col("pos") == F.col("size") + F.lit(index)).drop("size")


def list_trim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Keep only [start, stop] of every list, renumbered from 0."""
    d = _sized(lists)
    lo, hi = _bounds(start, stop, F.col("size"))
    hi = F.least(hi, F.col("size") - 1)
    return d.filter((F.col("pos") >= lo) & (F.col("pos") <= hi)).select(
        *[c for c in d.columns if c not in ("pos", "size")],
        (F.col("pos") - lo).alias("pos"), (hi - lo + 1).alias("size"))


def list_pop(lists: DataFrame, n: int = 1, right: bool = False
             ) -> tuple[DataFrame, DataFrame]:
    """Pop n elements from the left (or right) of every list.

    Returns (popped, remaining renumbered from 0).
    """
    d = _sized(lists)
    gone = (F.col("pos") >= F.col("size") - n) if right else (F.col("pos") < n)
    rest = d.filter(~gone).withColumn("size", F.col("size") - n)
    if not right:
        rest = rest.withColumn("pos", F.col("pos") - n)
    return d.filter(gone).drop("size"), rest


# ---------------------------------------------------------------- sets
def daily_active(events: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Active-user set per day (U9): key ``active:<yyyy-mm-dd>``.

    With ``days`` (``yyyy-mm-dd`` strings) only those days are built: each
    becomes a half-open time range on the raw column, so the day filter
    reaches the Parquet scan instead of running after the whole table is
    turned into sets.
    """
    if days:
        cond = None
        for d in sorted(set(days)):
            start = dt.datetime.fromisoformat(d)
            rng = ((F.col("timestamp") >= ts(start)) &
                   (F.col("timestamp") < ts(start + dt.timedelta(days=1))))
            cond = rng if cond is None else cond | rng
        events = events.filter(cond)
    return events.select(
        F.concat(F.lit("active:"), F.to_date("timestamp").cast("string")).alias("key"),
        F.col("user_id").cast("string").alias("member")).distinct()


def set_union(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members of any of ``keys``."""
    return sets.filter(F.col("key").isin(keys)).select("member").distinct()


def set_intersect(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members of every one of ``keys`` (U4): one grouped count, no chain of
    joins, however many keys."""
    return (sets.filter(F.col("key").isin(keys)).groupBy("member")
            .agg(F.countDistinct("key").alias("_k"))
            .filter(F.col("_k") == len(set(keys))).select("member"))


def set_diff(sets: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Members of ``first`` in none of ``others``."""
    a = sets.filter(F.col("key") == first).select("member").distinct()
    b = sets.filter(F.col("key").isin(others)).select(F.col("member").alias("_m"))
    return a.join(b, F.col("member").eqNullSafe(F.col("_m")), "left_anti")


def set_add(sets: DataFrame, adds: DataFrame) -> DataFrame:
    """Add members, duplicates ignored."""
    return sets.select("key", "member").unionByName(adds.select("key", "member")).distinct()


def set_remove(sets: DataFrame, removes: DataFrame) -> DataFrame:
    """Remove members."""
    r = removes.select(F.col("key").alias("_k"), F.col("member").alias("_m"))
    return sets.join(r, F.col("key").eqNullSafe(F.col("_k"))
                     & F.col("member").eqNullSafe(F.col("_m")), "left_anti")


def set_move(sets: DataFrame, moves: DataFrame) -> DataFrame:
    """Move (src, dst, member) where the member is in src (U7). Of several
    moves of one member from one set, the lowest ``seq`` (input order) wins."""
    from evtide.operators.mutations import with_seq
    m = (with_seq(moves).groupBy(F.col("src").alias("_k"), F.col("member").alias("_m"))
         .agg(F.min_by(F.struct("dst"), "seq").alias("_to")))
    j = sets.join(m, F.col("key").eqNullSafe(F.col("_k"))
                  & F.col("member").eqNullSafe(F.col("_m")), "left")
    # the move in a struct, so that one to the null key is told from none
    return j.select(F.when(F.col("_to").isNull(), F.col("key")).otherwise(F.col("_to.dst"))
                    .alias("key"), "member").distinct()


def set_sizes(sets: DataFrame) -> DataFrame:
    """Cardinality per key."""
    return sets.groupBy("key").agg(F.countDistinct("member").alias("size"))


def random_members(sets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n members per key without removal (U8), reproducible: ordered by a
    seeded hash of the member (md5, which other engines have too), not by
    ``rand()``, so the pick is the same for any partitioning."""
    w = Window.partitionBy("key").orderBy(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("member")).cast("binary")), "member")
    return (sets.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n).drop("_r"))


# ---------------------------------------------------------------- registers
def last_write(writes: DataFrame, first: bool = False) -> DataFrame:
    """Value of the last (or first) write per key by (ts, seq).

    ``max_by``/``min_by`` are mergeable aggregates: partial results are
    combined map-side, so a key written a billion times costs no more memory
    than any other.
    """
    order = F.struct("ts", "seq")
    pick = F.min_by if first else F.max_by
    return writes.groupBy("key").agg(pick("value", order).alias("value"),
                                     (F.min if first else F.max)("ts").alias("ts"))


def unexpired(writes: DataFrame, as_of, ttl_col: str = "ttl_s") -> DataFrame:
    """Last write per key, if it has not expired at ``as_of``."""
    order = F.struct("ts", "seq")
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "ts", ttl_col), order)
                                     .alias("_w"))
    exp = F.col("_w.ts") + F.make_dt_interval(secs=F.col(f"_w.{ttl_col}"))
    return (last.filter(F.col(f"_w.{ttl_col}").isNull() | (exp > ts(parse_ts(as_of))))
            .select("key", F.col("_w.value").alias("value"), F.col("_w.ts").alias("ts")))


def field_map(writes: DataFrame, as_map: bool = False) -> DataFrame:
    """Hash per key, last write per field.

    Long form (key, field, value) by default; ``as_map`` gathers each key's
    fields into one map (a key's field count, not its write count).
    """
    order = F.struct("ts", "seq")
    last = writes.groupBy("key", "field").agg(F.max_by("value", order).alias("value"))
    if not as_map:
        return last
    return last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("field", "value")))).alias("fields"))
