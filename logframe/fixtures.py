"""Service logs rendered from the ``events`` table, for the registered queries, tests and the bench.

The rule is plain enough that SQL can state the expected fields straight from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.functions import text as X
from logframe.operators.parse import parse_entries
from logframe.sources.catalog import Catalog, service_catalog
from logframe.sources.scratch import scratch_dir  # noqa: F401

SERVICES = 3
EVENTS_PER_FILE = 5000
ORPHAN = "log file opened"
LEVELS = {"error": "ERROR", "purchase": "WARN", "signup": "INFO", "view": "DEBUG", "click": "TRACE"}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def render(events: DataFrame) -> DataFrame:
    """One log block per event: service, event_id and the text in one of five line formats."""
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    level_map = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    level = F.try_element_at(level_map, F.col("event_type"))
    padded = F.rpad(level, 5, " ")
    site = (F.col("user_id") % 7).cast("string")
    tenant = (F.col("user_id") % 3).cast("string")
    triple = _text("u", uid, ",s", site, ",t", tenant)
    traced = F.col("event_id") % 11 != 0
    trace = F.when(traced, _text("tr", F.floor(F.col("event_id") / 10).cast("string"))).otherwise("")
    span = F.when(traced, _text("sp", eid)).otherwise("")
    ids = _text(" [app,", trace, ",", span, "]")
    thread = _text("[pool-", (F.col("event_id") % 8).cast("string"), "]")
    logger = _text("c.x.", F.col("event_type"))
    message = _text(F.col("event_type"), " value=", F.format_string("%.2f", "value"), " props=", F.col("props"))
    ts = X.ts_text(F.col("ts"))
    micros = F.rpad(F.substring(F.col("ts").cast("timestamp_ntz").cast("string"), 21, 6), 6, "0")
    iso = _text(F.left(F.replace(ts, F.lit(" "), F.lit("T")), F.lit(20)), micros, "Z")
    full = _text(ts, " host1 ", padded, " [", triple, "]", ids, " 4242 --- ", thread, " ", logger, " : ", message)
    context = F.when(F.col("user_id") % 2 == 0, _text("u", uid)).otherwise(triple)
    first = (
        F.when(F.col("event_id") % 5 == 0, _text("\x1b[37m", full))
        .when(F.col("event_id") % 5 == 1, full)
        .when(F.col("event_id") % 5 == 2, _text(iso, " main ", level, " ", message))
        .when(
            F.col("event_id") % 5 == 3,
            _text(ts, " ", padded, " [", context, "]", ids, " ", thread, " ", logger, " : ", message),
        )
        .otherwise(_text(ts, " ", padded, " []", ids, " ", thread, " ", logger, " {:} ", message))
    )
    gap = F.when(F.col("event_id") % 2 == 0, "\n").otherwise("")
    stack = _text("\njava.lang.X: event ", eid, "\n", gap, "\tat c.x.Y.run(Y.java:", eid, ")")
    block = F.when(level == "ERROR", F.concat(first, stack)).otherwise(first)
    service = _text("svc", (F.col("event_id") % SERVICES).cast("string"))
    return events.select(service.alias("service"), "event_id", block.alias("block"))


def event_entries(events: DataFrame) -> DataFrame:
    """Parsed entries straight from rendered blocks; the event id stands for line and offset."""
    blocks = render(events).select(
        "service",
        F.concat(F.col("service"), F.lit(".log")).alias("file_path"),
        F.col("event_id").alias("line_number"),
        F.col("event_id").alias("file_offset"),
        F.regexp_replace("block", "\n\n", "\n").alias("raw_line"),
    )
    return parse_entries(blocks)


def write_logs(events: DataFrame, root: str) -> Catalog:
    """Each service's active log as a directory of part files of 5,000 events' width.

    Every file starts with one line that belongs to no entry.
    """
    file_no = F.floor(F.col("event_id") / EVENTS_PER_FILE)
    opens_file = (F.col("event_id") % EVENTS_PER_FILE) < SERVICES
    lines = render(events).select(
        "service",
        F.lpad(file_no.cast("string"), 8, "0").alias("file_no"),
        "event_id",
        F.when(opens_file, F.concat(F.lit(ORPHAN + "\n"), "block")).otherwise(F.col("block")).alias("value"),
    )
    keys = ("service", "file_no")
    placed = lines.repartition(*keys).sortWithinPartitions(*keys, "event_id").drop("event_id")
    placed.write.partitionBy(*keys).text(f"{root}/live")
    return service_catalog((f"svc{i}", f"{root}/live/service=svc{i}") for i in range(SERVICES))


# Rotation by time: the first day of the month that goes into each log, newest log first.
ROTATED = (("app.log", 22), ("app.log.1", 15), ("app.log.2.gz", 8), ("app-week1.log.gz", 1))
UNRELATED = ("application.log", "other.log")


def write_rotated_logs(events: DataFrame, root: str) -> Catalog:
    """All events as one service: an active log, a plain and two gzip rotated logs, by day of month.

    Two unrelated logs lie in the same directory.
    """
    day, until = F.dayofmonth("ts"), 32
    parts = {}
    for name, since in ROTATED:
        parts[name] = events.filter((day >= since) & (day < until))
        until = since
    parts |= {name: parts["app.log"] for name in UNRELATED}
    for name, part in parts.items():
        ordered = part.repartitionByRange("event_id").sortWithinPartitions("event_id")
        codec = "gzip" if name.endswith(".gz") else "none"
        render(ordered).select("block").write.option("compression", codec).text(f"{root}/app/{name}")
    return service_catalog([("app", f"{root}/app/app.log", "#224466")])
