"""What a job writes, and how many micro-batches it takes, follows its input."""

import datetime as dt

from evtide.plans import q_streams
from evtide.session import hadoop_path, scratch_path
from evtide.sources import schemas, sinks
from evtide.streaming import streams

T0 = dt.datetime(2024, 1, 1, 6)


def files(spark, path):
    """(path, size) of the Parquet files under ``path``."""
    fs, p = hadoop_path(spark, path)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            out.append((f.getPath().toString(), f.getLen()))
    return out


def test_bloom_filters_are_sized_by_their_ids(spark):
    path = scratch_path(spark, "many-days")
    rows = [(i, i % 7, 1, '{"page":"/a"}', T0 + dt.timedelta(days=i % 40)) for i in range(200)]
    sinks.append_events(spark.createDataFrame(rows, schemas.EVENTS), path)
    found = files(spark, path)
    assert len(found) >= 40
    assert max(size for _, size in found) < 50_000      # 1 MB each before
    assert sorted(r.id for r in sinks.read_events(spark, path).collect()) == list(range(200))


def test_an_ingested_batch_has_a_file_per_day_not_per_task(spark):
    users = spark.createDataFrame([(1, "u", T0)], schemas.USERS)
    types = spark.createDataFrame([(1, "click")], schemas.EVENT_TYPES)
    src, acc = scratch_path(spark, "records"), scratch_path(spark, "accepted")
    rows = [(1, "click", (T0 + dt.timedelta(days=i % 30)).isoformat() + "Z", None)
            for i in range(480)]
    spark.createDataFrame(rows, schemas.INGEST_RECORD).repartition(4).write.json(src)
    streams.ingest_stream(streams.json_records(spark, src), lambda: users, lambda: types, acc,
                          scratch_path(spark, "rejects"), name=acc.rpartition("/")[2],
                          available_now=True).awaitTermination()
    assert streams.read_batches(spark, acc, schemas.EVENTS).count() == 480
    found = [f for f, _ in files(spark, acc) if "event_date=" in f]
    assert len(found) <= 30 + 8         # 30 in each of 4 tasks before


def test_batches_of_an_ordered_stream_do_not_grow_with_its_files(spark, tmp_path, monkeypatch):
    ts = "timestampadd(MINUTE, CAST(id * 10 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    spark.range(2000).selectExpr(
        "id AS event_id", f"{ts} AS ts", "id % 9 AS user_id", "'view' AS event_type",
        "0D AS value", "concat('{\"k\": ', id % 90, '}') AS props").write.parquet(
        str(tmp_path / "events.parquet"))
    spark.range(9).selectExpr("id AS c_custkey", "'c' AS c_name").write.parquet(
        str(tmp_path / "customer.parquet"))
    started, append = [], streams.append_stream

    def noted(*args, **kw):
        started.append(append(*args, **kw))
        return started[-1]
    monkeypatch.setattr(streams, "append_stream", noted)
    small = {"spark.sql.shuffle.partitions": "40", "spark.sql.files.maxPartitionBytes": "1k",
             "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        sf_dir = str(tmp_path)
        q_streams._t(spark, sf_dir)                         # 40 files
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        rows = q_streams.q_stream_rollup(spark, sf_dir).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.total_count for r in rows) == 2000
    assert started[0].lastProgress["batchId"] <= 8          # 20 or more before
