"""Bench: the published request shapes on raw logs and on the curated table.

As in the published set-up, 13 services have the same log: every event of ``$BENCH_SF_DIR``, so sf0.1
gives 13 x 100,000 entries. Every request reads all of them (full scan, no
scan depth) unless its name says otherwise. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import logframe as L  # noqa: E402
from logframe import fixtures as X  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SERVICES = 13

RECENT = {"from_ts": "2024-01-30 12:00:00", "to_ts": "2024-01-31 00:00:00"}
HISTORICAL = {"from_ts": "2024-01-10 13:00:00", "to_ts": "2024-01-11 15:00:00"}

# Request shapes by their published names; the ids and times are those of the events table.
TABLE_SHAPES: dict[str, dict] = {
    "t01_newest": {},
    "t02_oldest": {"sort_order": "asc"},
    "t03_trace": {"trace_id": "tr4242"},
    "t04_trace_oldest": {"trace_id": "tr4242", "sort_order": "asc"},
    "t05_span": {"span_id": "sp4242"},
    "t06_trace_time": {"trace_id": "tr4242", **RECENT},
    "t08_trace_historical": {"trace_id": "tr31", **HISTORICAL},
    "t11_debug": {"level": "DEBUG"},
    "t12_info": {"level": "INFO"},
    "t15_error_historical": {"level": "ERROR", **HISTORICAL},
    "t16_user": {"user_id": "u1"},
    "t17_site": {"site_id": "s3"},
    "t18_tenant": {"tenant_id": "t2"},
    "t19_logger": {"logger": "SIGNUP"},
    "t20_message": {"message": "value=3"},
    "t21_recent": RECENT,
    "t22_historical": HISTORICAL,
    "t23_historical_oldest": {"sort_order": "asc", **HISTORICAL},
    "t24_keyword": {"query": "purchase"},
    "t25_boolean": {"query": "level:WARN AND message:value=1"},
    "t26_field": {"query": "logger:signup"},
    "t27_complex": {"query": "(level:INFO OR level:WARN) AND message:value=3"},
    "t28_not": {"query": "NOT level:DEBUG"},
    "t29_trace_user_time": {"trace_id": "tr31", "user_id": "u1", **HISTORICAL},
    "t30_info_logger_message": {"level": "INFO", "logger": "signup", "message": "value=1"},
    "t31_warn_query": {"level": "WARN", "query": "purchase"},
    "t32_next_page": {"start": 500},
    "t33_one_service": {"services": ("svc07",)},
    "t34_limit_5000": {"limit": 5000},
    "t35_limit_all": {"limit": 50_000},  # the most that the published runs return
    "t43_traces": {"trace_id": "tr31,tr4242"},
    "t47_query_oldest": {"query": "purchase", "sort_order": "asc"},
}
RAW_SHAPES = (
    "t01_newest t02_oldest t03_trace t06_trace_time t11_debug t16_user t20_message t22_historical t24_keyword"
    " t25_boolean t27_complex t28_not t33_one_service t35_limit_all"
).split()
DEPTH = {"scan_depth": 100_000}
# A fifth of each log.
SHALLOW = {"scan_depth": 20_000}


def write_logs(spark: SparkSession, root: str) -> tuple[L.Service, ...]:
    """The same log for each service: a directory of four files, cut by time."""
    events = X.read_events(spark, SF_DIR)
    blocks = X.render(events).drop("service").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SERVICES - 1)))
    lines = blocks.select("event_id", copies.alias("copy"), F.col("block").alias("value"))
    service = F.format_string("svc%02d", "copy").alias("service")
    ordered = lines.select(service, "event_id", "value").sortWithinPartitions("service", "event_id")
    ordered.drop("event_id").write.partitionBy("service").text(f"{root}/live")
    return L.service_catalog((f"svc{i:02d}", f"{root}/live/service=svc{i:02d}") for i in range(SERVICES))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        # Small splits and several partitions per core, so that tasks balance at this data size.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.shuffle.partitions", str(8 * int(CPUS)))
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        rows = run()
        times[name] = round(time.time() - start, 3)
        print(f"{name:28} {times[name]:8.3f}s {rows}", file=sys.stderr, flush=True)

    root = X.scratch_dir(spark)
    catalog = write_logs(spark, root)
    for _ in range(2):  # a server answers with a warm JVM
        L.search(spark, catalog, level="WARN").page.collect()
    timed("index", lambda: L.write_log_index(spark, catalog, f"{root}/index"))
    index = L.read_log_index(spark, f"{root}/index")
    for name in RAW_SHAPES:
        request = TABLE_SHAPES[name]
        timed(f"raw_{name}", lambda: len(L.search(spark, catalog, index=index, **request).page.collect()))
        if "from_ts" in request:
            timed(f"raw_{name}_no_index", lambda: len(L.search(spark, catalog, **request).page.collect()))
    timed("raw_t01_depth_100k", lambda: len(L.search(spark, catalog, **DEPTH).page.collect()))
    timed("raw_t01_depth_20k", lambda: len(L.search(spark, catalog, **SHALLOW).page.collect()))
    timed("raw_summary", lambda: L.search(spark, catalog, level="WARN").summary().collect())
    timed("ingest", lambda: L.write_entries(L.read_services(spark, catalog), f"{root}/entries"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    table = L.read_entries(spark, f"{root}/entries")
    for name, request in TABLE_SHAPES.items():
        timed(f"table_{name}", lambda: len(L.search_table(table, **request).page.collect()))
    timed("table_t01_depth_100k", lambda: len(L.search_table(table, **DEPTH).page.collect()))
    timed("table_t01_depth_20k", lambda: len(L.search_table(table, **SHALLOW).page.collect()))
    timed("table_summary", lambda: L.search_table(table, level="WARN").summary().collect())
    view = L.search_table(table, level="ERROR").view
    timed("export_csv", lambda: L.write_csv(view, f"{root}/csv"))
    timed("export_txt", lambda: L.write_txt(view, f"{root}/txt"))
    counts = table.agg(F.count("*")).collect()[0][0]
    print(
        json.dumps(
            {
                "metric": "sum of search, ingest and export times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "entries": counts,
                "scan": "full scan; *_depth_* with that scan_depth per service",
            }
        )
    )


if __name__ == "__main__":
    main()
