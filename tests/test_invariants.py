"""Invariants between operators on the smallest tables."""

from pyspark.sql import functions as F

from evtide.operators import metrics, reads, report, rollup
from evtide.plans.catalog import AS_OF, FROM, TO
from evtide.sources import schemas
from evtide.sources.driver_tables import stored

SF = "/root/testdata/sf0.001"


def test_totals_equal_sum_of_types(spark):
    t = stored(spark, SF)
    r = rollup.stats_rollup(t.events, t.event_types, as_of=AS_OF)
    rep = report.stats_report(r, FROM, TO, now=AS_OF).collect()
    ev = [x for x in rep if x.result_type == "events"]
    tot = [x for x in rep if x.result_type == "totals"][0]
    assert tot["count"] == sum(x["count"] for x in ev)
    assert tot.unique_users == sum(x.unique_users for x in ev)


def test_series_totals_equal_range_count(spark):
    t = stored(spark, SF)
    series = metrics.timeseries(t.events, t.event_types, "hour", FROM, TO)
    per_bucket = series.select("bucket_start", "total_events").distinct()
    total = per_bucket.agg(F.sum("total_events")).first()[0]
    direct = metrics.count_events(t.events, t.event_types, FROM, TO).first()[0]
    assert total == direct


def test_cursor_pages_concatenate_to_full_sort(spark):
    t = stored(spark, SF)
    ev = reads.filter_events(t.events, user_id=3)
    full = [r.id for r in ev.orderBy(F.col("timestamp").desc(), F.col("id").desc()).collect()]
    got, cur_ts, cur_id = [], None, None
    while True:
        page = reads.events_cursor(t.events, cur_ts, cur_id, limit=2, user_id=3).collect()
        got += [r.id for r in page]
        if not page or page[-1].next_timestamp is None:
            break
        cur_ts, cur_id = page[-1].next_timestamp, page[-1].next_id
    assert got == full


def test_offset_pages_concatenate_to_full_sort(spark):
    t = stored(spark, SF)
    full = [r.id for r in reads.users_by_name(t.users).collect()]
    got = []
    for off in range(0, len(full), 40):
        got += [r.id for r in reads.users_page(t.users, limit=40, offset=off).collect()]
    assert got == full


def test_unicode_collation_option(spark):
    u = spark.createDataFrame([(1, "b", None), (2, "B", None), (3, "a", None)], schemas.USERS)
    assert [r.name for r in reads.users_by_name(u).collect()] == ["B", "a", "b"]
    assert [r.name for r in reads.users_by_name(u, "UNICODE").collect()] == ["a", "b", "B"]
