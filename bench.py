"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is materialised in full with the ``noop``
sink (no driver collect); the reported time is the median of three warm
runs, the cold first run is reported alongside. The canonical tables are
loaded once before the queries and timed separately. Generation + bulk load (G3 + W14)
is measured in events/s at $BENCH_GEN_ROWS rows (default 10,000,000, the
reference seeder's default size), and so is the validated ingest path
(W1-W3 + W14) over the same records. Neither counts towards ``value``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from evtide.plans.catalog import AS_OF, QUERIES  # noqa: E402
from evtide.session import build_session, scratch_path  # noqa: E402
from evtide.operators import mutations  # noqa: E402
from evtide.sources import generate, sinks  # noqa: E402
from evtide.sources.driver_tables import stored  # noqa: E402

HEADLINE = {
    "A12_stats_report": "stats_report",
    "A6_A8_stats_rollup": "stats_rollup",
    "A15_timeseries_hour": "timeseries_hour",
    "K1_list_events": "list_events",
    "U4_active_users_intersect": "active_users_intersect",
    "A4_event_type_stats": "event_type_stats",
    "A23_sessions": "sessions",
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    gen_rows = int(os.environ.get("BENCH_GEN_ROWS", "10000000"))
    spark = build_session(f"local[{cpus}]", "evtide-bench", shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.files.maxPartitionBytes": str(128 << 20)})
    spark.sparkContext.setLogLevel("ERROR")

    # one-time load of the canonical tables (the ingest-side layout), timed apart
    t0 = time.perf_counter()
    stored(spark, sf_dir)
    load_sec = time.perf_counter() - t0

    queries, cold = {}, {}
    for label, name in HEADLINE.items():
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        cold[label] = round(time.perf_counter() - t0, 3)
        warm = []
        for _ in range(3):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            warm.append(time.perf_counter() - t0)
        queries[label] = round(statistics.median(warm), 3)

    # G3 + W14: generate events and bulk-append them partitioned by day.
    users = generate.users(spark, 1000, AS_OF).select(
        (F.col("id") - 1).alias("idx"), F.col("id").alias("user_id"))
    types = generate.event_types(spark, 100)
    gen = generate.events(spark, gen_rows, users, types, as_of=AS_OF,
                          num_partitions=4 * cpus)
    ev = gen.join(types.select(F.col("name").alias("event_type"),
                               F.col("id").alias("event_type_id")), "event_type")
    ev = ev.select(F.col("seq").alias("id"), "user_id", "event_type_id", "metadata", "timestamp")
    t0 = time.perf_counter()
    sinks.append_events(ev, scratch_path(spark, "bench-events"))
    gen_sec = time.perf_counter() - t0
    queries["G3_W14_generate_load"] = round(gen_sec, 3)

    # W1 + W2 + W3 + W14: the validated ingest path (type names resolved, users
    # checked, dense ids assigned, rejects split off) over the same records.
    recs = gen.drop("seq")
    t0 = time.perf_counter()
    out = mutations.ingest_events(recs, users.select(F.col("user_id").alias("id")),
                                  types.select("id", "name"), as_of=AS_OF, base_id=0)
    sinks.append_events(out.table.drop("seq"), scratch_path(spark, "bench-ingest"))
    rejects = out.report.count()
    ingest_sec = time.perf_counter() - t0
    queries["W1_ingest"] = round(ingest_sec, 3)

    print(json.dumps({
        "metric": "headline_queries_total_warm",
        "value": round(sum(v for k, v in queries.items()
                           if not k.startswith(("G3", "W1"))), 3),
        "unit": "sec",
        "queries": queries,
        "cold": cold,
        "load_canonical_sec": round(load_sec, 3),
        "gen_events_per_sec": round(gen_rows / gen_sec),
        "ingest_events_per_sec": round(gen_rows / ingest_sec),
        "ingest_rejects": rejects,
        "gen_rows": gen_rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
