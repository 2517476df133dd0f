"""The physical plans keep the properties the scale design relies on."""

import re

import pytest

from evtide.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, SF)
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_listing_is_topk_before_the_name_join(spark):
    p = plan(spark, "list_events")
    assert "TakeOrderedAndProject(limit=200, offset=100" in p
    assert p.index("BroadcastHashJoin") < p.index("TakeOrderedAndProject")  # join above top-k


def test_per_user_topk_is_cut_before_the_shuffle(spark):
    p = plan(spark, "recent_activity")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_range_predicates_reach_the_scan(spark):
    p = plan(spark, "count_events")
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp," in p


def test_report_reads_snapshot_partitions(spark):
    p = plan(spark, "stats_report")
    assert "PartitionFilters: [isnotnull(stat_type), (stat_type = event_type)]" in p
    assert "PartitionFilters: [isnotnull(stat_type), (stat_type = page)]" in p


def test_retention_prunes_day_partitions(spark):
    p = plan(spark, "retention_partitioned")
    assert "PartitionFilters: [isnotnull(event_date), (event_date >= 2024-01-15)]" in p


@pytest.mark.parametrize("name", ["page_analytics", "referrer_analytics", "product_analytics",
                                  "sessions", "top_pages", "users_with_metrics", "stats_rollup"])
def test_analytics_parse_no_json(spark, name):
    p = plan(spark, name)
    assert "json" not in p.lower() and "variant" not in p.lower()


@pytest.mark.parametrize("name,column", [("page_analytics", "m_page"),
                                         ("sessions", "m_session_id"),
                                         ("product_analytics", "m_product_id")])
def test_missing_fields_are_filtered_by_the_scan(spark, name, column):
    assert f"IsNotNull({column})" in plan(spark, name)


@pytest.mark.parametrize("name", ["timeseries_hour", "realtime_metrics", "report_exact_users"])
def test_metrics_scan_the_events_once(spark, name):
    scans = [x for x in plan(spark, name).split("\n") if "FileScan" in x and "user_id" in x]
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["leaderboard_rank", "leaderboard_middle", "list_range",
                                  "list_last", "list_trim_sizes", "list_pop_rest",
                                  "session_pages", "global_rank"])
def test_ranked_rows_meet_one_range_exchange(spark, name):
    # its result is checkpointed; what follows numbers rows where they are
    p = plan(spark, name)
    assert "MapInArrow" in p and "rangepartitioning" not in p and "Window" not in p
    for line in p.split("\n"):
        if "Exchange" in line:      # the final count of list_trim_sizes
            assert name == "list_trim_sizes" and "hashpartitioning(key" in line


@pytest.mark.parametrize("name", ["leaderboard_range", "leaderboard_tail", "leaderboard_last",
                                  "score_range"])
def test_short_ranges_are_cut_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_retention_counts_only_old_days(spark):
    from evtide.operators import mutations
    from evtide.plans.q_mutations import _events_by_day
    table = spark.read.parquet(_events_by_day(spark, SF))
    old = table.filter("event_date <= DATE'2024-01-15'")
    p = mutations.retention_scope(old, "2024-01-15 12:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in p


def test_rollup_aggregates_before_joining_names(spark):
    p = plan(spark, "stats_rollup")
    assert "partial_count(distinct user_id" in p
    join = p.index("BroadcastHashJoin")
    assert "HashAggregate" in p[join:]


def scanned_rows(df) -> int:
    """Rows that the scans of an executed plan gave out."""
    df.collect()

    def walk(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        own = (node.metrics().apply("numOutputRows").value()
               if node.nodeName().startswith("Scan parquet") else 0)
        kids = node.children()
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_a_lookup_skips_row_groups(spark, tmp_path):
    from evtide.operators import reads
    from evtide.sources import sinks
    rows = spark.range(0, 40_000).selectExpr("id * 7919 % 40000 AS id", "'x' AS v")
    path = str(tmp_path / "t")
    # every file spans nearly all ids, so only the bloom filters can tell
    sinks.with_id_filters(rows.repartition(16).write).parquet(path)
    table = spark.read.parquet(path)
    keys = spark.createDataFrame([(5,), (77,), (10 ** 9,), (5,), (None,)], "id long")
    found = reads.lookup_few(table, keys)
    assert sorted(r.id for r in found.collect()) == [5, 77]
    assert scanned_rows(found) <= 40_000 * 5 // 16
    assert scanned_rows(table.where("id >= 0")) == 40_000
    many = spark.range(0, 1000)
    assert reads.lookup_few(table, many).count() == 1000
    assert reads.lookup_few(table, keys.limit(0)).collect() == []


def test_a_stored_variant_is_not_parsed_again(spark):
    p = plan(spark, "numeric_sessions")
    assert "parse_json" not in p.lower() and "variant_get" in p.lower()


def test_names_in_the_order_of_a_collation(spark):
    from evtide.operators import reads
    names = ["b", "A", "a", "C", "B", "ä"]
    users = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)],
                                  "id long, name string, created_at timestamp_ntz")
    order = [r.name for r in reads.users_by_name(users, "UNICODE").collect()]
    assert order == ["a", "A", "ä", "b", "B", "C"]
    for deep in (False, True):
        got = reads.users_page(users, 3, 1, deep, collation="UNICODE").collect()
        assert [r.name for r in got] == order[1:4] and got[0].asDict().keys() == {
            "id", "name", "created_at"}
    page, cursor = [], None
    while True:
        got = reads.users_cursor(users, cursor, 2, collation="UNICODE").collect()
        page += [r.name for r in got]
        cursor = got[-1].next_name if got else None
        if cursor is None:
            break
    assert page == order


@pytest.mark.parametrize("name", ["leaderboard_top", "recent_activity"])
def test_no_rows_have_the_same_types(spark, name):
    from evtide.operators import keyed, reads
    from evtide.plans.q_keyed import type_boards
    from evtide.plans.registry import _t
    if name == "leaderboard_top":
        b = type_boards(spark, SF)
        assert keyed.top(b, 0).dtypes == keyed.top(b, 1).dtypes
    else:
        e = _t(spark, SF).events
        assert reads.latest_per_user(e, 0).dtypes == reads.latest_per_user(e, 1).dtypes
