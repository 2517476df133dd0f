"""Stored ranges: pages by position, ranks of given members, increments."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evtide.operators import keyed, ranked
from evtide.plans.catalog import QUERIES
from evtide.session import scratch_path
from evtide.sources import ranges

SF = "/root/testdata/sf0.001"
BOARD = "board string, member string, score double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_at_every_offset(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(9), i, f"x{i}") for i in range(83)]
    base = scratch_path(spark, "ranges")
    ranges.write(spark.createDataFrame(rows, "k int, i int, v string"), base, ["k", "i"], ranges=7)
    rows.sort()
    for down, want in ((False, rows), (True, rows[::-1])):
        for offset, limit in ((0, 1), (0, 100), (5, 20), (40, 3), (82, 5), (83, 5), (500, 1), (30, 0)):
            got = ranges.page(spark, base, limit, offset, down)
            assert [tuple(r) for r in got.collect()] == want[offset:offset + limit]


def test_empty_table(spark):
    base = scratch_path(spark, "ranges")
    ranges.write(spark.createDataFrame([], "k int, i int"), base, ["k", "i"])
    assert ranges.page(spark, base, 5).collect() == []
    board = scratch_path(spark, "board")
    ranked.write(spark.createDataFrame([], BOARD), board)
    wanted = spark.createDataFrame([("a", "m")], "board string, member string")
    assert ranked.ranks_of(spark, board, wanted).collect() == []
    ranked.add_scores(spark, board, wanted.withColumn("delta", F.lit(2.0)))
    assert [tuple(r) for r in ranked.ranks_of(spark, board, wanted).collect()] == [
        ("a", "m", 2.0, 0, 0)]


@pytest.mark.parametrize("name", ["list_events_deep", "events_page_indexed", "users_page_indexed"])
def test_a_deep_page_opens_its_own_ranges_only(spark, name):
    df = QUERIES[name](spark, SF)
    text = plan(df)
    assert "rangepartitioning" not in text and "TakeOrderedAndProject" in text
    assert 1 <= len([f for f in df.inputFiles() if "/range=" in f]) <= 2


def boards(seed, n=400):
    rng = random.Random(seed)
    names = ["hot"] * 30 + [None] + [f"b{i}" for i in range(6)]
    seen = {(rng.choice(names), rng.choice([None, *(f"m{i}" for i in range(n))])) for _ in range(n)}
    return [(b, m, float(rng.randrange(-4, 5))) for b, m in seen]


def ranks(df):
    return sorted(((r.board, r.member, r.score, r["rank"], r.reverse_rank) for r in df.collect()),
                  key=str)


def test_ranks_of_given_members_and_increments(spark):
    rows = boards(1)
    df = spark.createDataFrame(rows, BOARD)
    base = scratch_path(spark, "board")
    ranked.write(df, base, num_ranges=6)
    rng = random.Random(7)
    for k in range(3):
        full = ranks(keyed.with_ranks(df))
        picked = rng.sample([r[:2] for r in full], 25) + [("hot", "nobody"), ("none", "m1")]
        wanted = spark.createDataFrame(picked * 2, "board string, member string")
        assert ranks(ranked.ranks_of(spark, base, wanted)) == [
            r for r in full if r[:2] in picked]
        deltas = [(b, m, float(rng.randrange(-9, 10))) for b, m in picked] + [
            (f"new{k}", "m", 1.0), ("hot", picked[0][1], -50.0), ("a-first", f"x{k}", 0.5)]
        inc = spark.createDataFrame(deltas, "board string, member string, delta double")
        ranked.add_scores(spark, base, inc)
        totals = {(r.board, r.member): r.score for r in df.collect()}
        for b, m, d in deltas:
            totals[b, m] = totals.get((b, m), 0.0) + d
        df = spark.createDataFrame([(*k, v) for k, v in totals.items()], BOARD)
        every = df.select("board", "member")
        assert ranks(ranked.ranks_of(spark, base, every)) == ranks(keyed.with_ranks(df))


def test_ranks_of_a_few_read_few_ranges_and_sort_no_board(spark):
    rows = [("hot", f"m{i:04d}", float(i)) for i in range(3000)]
    base = scratch_path(spark, "board")
    ranked.write(spark.createDataFrame(rows, BOARD), base, num_ranges=30)
    wanted = spark.createDataFrame([("hot", "m1500"), ("hot", "m1501")],
                                   "board string, member string")
    df = ranked.ranks_of(spark, base, wanted)
    assert ranks(df) == [("hot", "m1500", 1500.0, 1500, 1499), ("hot", "m1501", 1501.0, 1501, 1498)]
    text = plan(df)
    assert "rangepartitioning" not in text
    for x in text.split("\n"):
        if "FileScan" in x and "bucket#" in x:
            assert re.search(r"PartitionFilters: \[[^\]]*bucket#", x)
    held = {f.split("/range=")[1].split("/")[0] for f in df.inputFiles() if "/range=" in f}
    assert len(held) <= 2


def test_a_broken_off_change_is_mended_by_counting_anew(spark, monkeypatch):
    base = scratch_path(spark, "board")
    df = spark.createDataFrame(boards(5, 60), BOARD)
    ranked.write(df, base, num_ranges=4)
    with monkeypatch.context() as m:
        m.setattr(ranges, "_write_index", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rows = ranges.data(spark, base).where("member = 'm1'")
            ranges.merge(spark, base, rows, rows.limit(0))
    ranges.reindex(spark, base)
    total = ranges.index(spark, base).agg(F.sum("n")).first()[0]
    assert total == ranges.data(spark, base).count() == df.where(
        "member is null or member <> 'm1'").count()


def test_trim_drops_whole_ranges_and_rewrites_one(spark):
    import os
    rows = [(i // 3, f"t{i:03d}", i) for i in range(100)]           # ids repeat
    base = scratch_path(spark, "log")
    df = spark.createDataFrame(rows, "id long, tie string, v int")
    ranges.write(df, base, ["id", "tie"], ranges=8)
    root = f"{base}/data".removeprefix("file:")

    def files():
        return {d: sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root)
                if d.startswith("range=")}
    for keep in (200, 100, 61, 60, 7, 0):
        old = files()
        size = ranges.data(spark, base).count()
        assert ranges.trim(spark, base, keep) == max(size - keep, 0)
        assert sorted(r.v for r in ranges.data(spark, base).collect()) == list(
            range(100 - min(keep, 100), 100))
        new = files()
        assert sum(old[d] != new[d] for d in new) <= 1
        total = ranges.index(spark, base).agg(F.sum("n"), F.max("total")).first()
        assert total[0] == total[1] == (keep if keep < 100 else 100) or keep == 0
    assert ranges.after(spark, base, None, 5).collect() == []


def test_rows_behind_a_key(spark):
    rows = [(i // 3, None if i % 5 == 0 else f"t{i:03d}", i) for i in range(60)]
    base = scratch_path(spark, "log")
    ranges.write(spark.createDataFrame(rows, "id long, tie string, v int"), base, ["id", "tie"],
                 ranges=6)
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    at = None
    for count in (1, 4, 4, 30, 10, 10, 10):
        want = rows[:count]
        df = ranges.after(spark, base, at, count)
        assert [tuple(r) for r in df.collect()] == want
        at = want[-1][:2] if want else at
        rows = rows[count:]
    few = ranges.after(spark, base, (3, "t010"), 2)
    assert len([f for f in few.inputFiles() if "/range=" in f]) <= 2


def test_pages_by_their_ends(spark):
    rows = [(None if i < 4 else i // 3, None if i % 5 == 0 else f"t{i:03d}", i) for i in range(60)]
    base = scratch_path(spark, "log")
    ranges.write(spark.createDataFrame(rows, "id long, tie string, v int"), base, ["id", "tie"],
                 ranges=6)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    known = ranges.fences(spark, base)
    assert sum(r.n for r in known) == 60 and len(known) == 6
    for at, count, pages in ((None, 3, 4), (rows[1][:2], 7, 3), (rows[49][:2], 4, 9),
                             (rows[59][:2], 4, 2)):
        left = [r for r in rows if at is None or rows.index(r) > [x[:2] for x in rows].index(at)]
        cut = [left[k:k + count] for k in range(0, len(left), count)][:pages]
        ends = ranges.ends(spark, base, at, count, pages, known)
        assert ends == [(list(c[-1][:2]), len(c)) for c in cut]
        for want, (last, _) in zip(cut, ends):
            page = ranges.between(spark, base, at, last)
            assert [tuple(r) for r in page.collect()] == want
            assert len([f for f in page.inputFiles() if "/range=" in f]) <= 2
            at = last
