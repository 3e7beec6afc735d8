"""The registered queries: every operator run over the whole ``events`` table (one over ``documents``).

Operators on fields read entries rendered map-side from ``events``; operators on files read logs that
Spark has written from the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import logframe as L
from logframe import fixtures as X
from logframe.functions import patterns as P
from logframe.functions import text as T
from logframe.plans.search import SearchResult
from logframe.sinks import export
from logframe.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_written: dict[tuple[str, str, str], tuple] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.event_entries(X.read_events(spark, sf_dir))


def _once(spark: SparkSession, sf_dir: str, kind: str, write) -> tuple:
    """Logs and tables are written once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        root = X.scratch_dir(spark)
        _written[key] = (write(root), root)
    return _written[key]


def live_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return _once(spark, sf_dir, "live", lambda root: X.write_logs(X.read_events(spark, sf_dir), root))[0]


def rotated_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    events = X.read_events(spark, sf_dir)
    return _once(spark, sf_dir, "rotated", lambda root: X.write_rotated_logs(events, root))[0]


def table_path(spark: SparkSession, sf_dir: str) -> str:
    live = L.read_services(spark, live_catalog(spark, sf_dir))
    return _once(spark, sf_dir, "table", lambda root: L.write_entries(live, f"{root}/entries"))[1] + "/entries"


def index_path(spark: SparkSession, sf_dir: str) -> str:
    catalog = live_catalog(spark, sf_dir)
    return _once(spark, sf_dir, "index", lambda root: L.write_log_index(spark, catalog, f"{root}/index"))[1] + "/index"


def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.read_services(spark, live_catalog(spark, sf_dir))


def file_no() -> Column:
    return F.regexp_extract("file_path", r"file_no=0*(\d+)/", 1).cast("long").alias("file_no")


def brief(df: DataFrame) -> DataFrame:
    return df.select(F.col("file_offset").alias("event_id"), "service", "level", "message")


def placed(df: DataFrame) -> DataFrame:
    return df.select(
        "service",
        file_no(),
        "line_number",
        "file_offset",
        T.ts_text(F.col("ts")).alias("ts"),
        "level",
        "message",
    )


def micros(ts: Column) -> Column:
    text = ts.cast("string")
    return F.concat(F.left(text, F.lit(19)), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))


# --- sources -------------------------------------------------------------------------------------


@query
def text_log_scan(spark, sf_dir):
    lines = L.read_service_lines(spark, live_catalog(spark, sf_dir))
    service = F.regexp_extract("file_path", r"service=(\w+)/", 1).alias("service")
    return lines.groupBy(service, file_no()).agg(
        F.count("*").alias("n_lines"),
        F.sum(T.line_bytes(F.col("value"))).alias("n_bytes"),
        F.count_if(T.is_new_entry(F.col("value"))).alias("n_entries"),
    )


@query
def gzip_log_scan(spark, sf_dir):
    service = rotated_catalog(spark, sf_dir)[0]
    lines = L.read_log_lines(spark, [f"{service.directory}/{name}" for name, _ in X.ROTATED])
    log = F.element_at(F.split("file_path", "/"), -2).alias("log")
    return lines.groupBy(log).agg(F.count("*").alias("n_lines"))


@query
def multi_service_scan(spark, sf_dir):
    catalog = live_catalog(spark, sf_dir)
    return placed(L.read_services(spark, catalog, ["svc2", "unknown", "svc0"]))


@query
def service_catalog(spark, sf_dir):
    catalog = L.catalog_frame(spark, live_catalog(spark, sf_dir))
    counts = entries(spark, sf_dir).groupBy(F.col("service").alias("name")).agg(F.count("*").alias("n"))
    return catalog.join(counts, "name", "left").select(
        "name", "color", F.coalesce("n", F.lit(0)).alias("n_entries")
    )


@query
def service_status(spark, sf_dir):
    catalog = live_catalog(spark, sf_dir)
    absent = L.Service("absent", catalog[0].log_file + "-absent", "#00ff00")
    status = L.service_status(spark, (*catalog, absent))
    counts = entries(spark, sf_dir).groupBy(F.col("service").alias("name")).agg(F.count("*").alias("n_entries"))
    return status.join(counts, "name", "left").select(
        "name",
        "color",
        "exists",
        "size_kb",
        (F.col("last_modified") != "N/A").alias("has_time"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
    )


@query
def list_rotated(spark, sf_dir):
    catalog = rotated_catalog(spark, sf_dir)
    found = L.list_rotated(spark, catalog, "app")
    lines = L.read_log_lines(spark, [f"{catalog[0].directory}/{name}" for name, _ in X.ROTATED[1:]])
    log = F.element_at(F.split("file_path", "/"), -2).alias("name")
    counts = lines.groupBy(log).agg(F.count_if(T.is_new_entry(F.col("value"))).alias("n_entries"))
    instant = F.to_timestamp("last_modified", "yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'")
    ordered = found.withColumn("nth", F.monotonically_increasing_id()).withColumn("at", instant)
    # A compressed log's size is not known from its text.
    size = F.when(F.col("name").endswith(".gz"), 0).otherwise(F.col("size_kb"))
    by_time = F.row_number().over(Window.orderBy(F.desc("at"), "name")) == F.row_number().over(Window.orderBy("nth"))
    return ordered.join(counts, "name", "left").select("name", size.alias("size_kb"), by_time.alias("in_order"), "n_entries")


@query
def rotated_file_scan(spark, sf_dir):
    catalog = rotated_catalog(spark, sf_dir)
    names = [name for name, _ in X.ROTATED[1:]]
    parts = [L.read_rotated(spark, catalog, "app", n).withColumn("log", F.lit(n)) for n in names]
    parts.append(L.read_services(spark, catalog).withColumn("log", F.lit(X.ROTATED[0][0])))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        "service", "log", T.ts_text(F.col("ts")).alias("ts"), "level", "user_id", "message", "stack_trace"
    )


@query
def resume_newest_first(spark, sf_dir):
    cursors = {"svc0": 100_000, "svc1": 5_000}
    return placed(L.resume(live_entries(spark, sf_dir), cursors, "desc", default=70_000))


@query
def resume_oldest_first(spark, sf_dir):
    return placed(L.resume(live_entries(spark, sf_dir), {"svc0": 100_000, "svc1": 5_000}, "asc"))


# --- assembly ------------------------------------------------------------------------------------


@query
def new_entry_test(spark, sf_dir):
    blocks = X.render(X.read_events(spark, sf_dir))
    fmt = F.element_at(F.array(*map(F.lit, ("FULL", "FULL", "ISO", "SLIM", "SLIM"))), F.expr("int(event_id % 5) + 1"))
    lines = blocks.select("service", fmt.alias("log_format"), F.explode(F.split("block", "\n")).alias("line"))
    new = T.is_new_entry(F.col("line"))
    return lines.groupBy("service", "log_format").agg(
        F.count_if(new).alias("n_new"), F.count_if(~new).alias("n_other")
    )


@query
def assemble_blocks(spark, sf_dir):
    catalog = live_catalog(spark, sf_dir)
    lines, files = L.read_service_lines(spark, catalog), L.list_log_files(spark, catalog)
    blocks = L.assemble_entries(lines, files)
    return blocks.select("service", file_no(), "entry_seq", "line_number", "file_offset", "raw_line")


@query
def assemble_keep_blank(spark, sf_dir):
    catalog = live_catalog(spark, sf_dir)
    lines, files = L.read_service_lines(spark, catalog), L.list_log_files(spark, catalog)
    blocks = L.assemble_entries(lines, files, keep_blank=True, keep_orphan=False)
    return blocks.select("service", file_no(), "entry_seq", "line_number", "file_offset", "raw_line")


@query
def orphan_heads(spark, sf_dir):
    return placed(live_entries(spark, sf_dir).filter(F.col("log_format") == "RAW"))


# --- parsing -------------------------------------------------------------------------------------


@query
def parse_formats(spark, sf_dir):
    df = entries(spark, sf_dir).drop("line_number", "file_path").withColumnRenamed("file_offset", "event_id")
    return df.withColumn("ts", micros(F.col("ts")))


@query
def strip_ansi(spark, sf_dir):
    blocks = X.render(X.read_events(spark, sf_dir))
    return blocks.select("event_id", T.strip_ansi(T.first_line(F.col("block"))).alias("line"))


@query
def split_block(spark, sf_dir):
    df = entries(spark, sf_dir).select(F.col("file_offset").alias("event_id"), "raw_line")
    return df.select("event_id", T.split_block(F.col("raw_line")).alias("s")).select("event_id", "s.*")


@query
def split_context(spark, sf_dir):
    events = X.read_events(spark, sf_dir)
    triple = F.expr("concat('u', user_id, ',s', user_id % 7, ',t', user_id % 3)")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, triple)
        .when(kind == 1, F.concat(triple, F.lit(",x")))
        .when(kind == 2, F.expr("concat('u', user_id, ', s ,')"))
        .when(kind == 3, F.expr("concat('u', user_id)"))
        .otherwise("")
    )
    return events.select("event_id", T.split_context(text).alias("c")).select("event_id", "c.*")


@query
def simple_fallback(spark, sf_dir):
    """Levels that are not padded to five characters miss both structured formats."""
    events = X.read_events(spark, sf_dir)
    level = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in X.LEVELS.items() for x in pair]), F.col("event_type")
    )
    block = F.concat(
        T.ts_text(F.col("ts")),
        F.lit(" host1 "),
        level,
        F.expr("concat(' [u', user_id, ',s', user_id % 7, ',t', user_id % 3, '] [app,,] 1 --- [main] c.X : ')"),
        F.concat("event_type", F.lit(" value="), F.format_string("%.2f", "value"), F.lit(" props="), "props"),
    )
    df = L.parse_entries(events.select(F.col("event_id").alias("line_number"), block.alias("raw_line")))
    return df.select(F.col("line_number").alias("event_id"), "log_format", "level", "user_id", "message")


@query
def raw_fallback(spark, sf_dir):
    text = F.format_string("  %s value=%.2f props=%s ", "event_type", "value", "props")
    events = X.read_events(spark, sf_dir).select(F.col("event_id").alias("line_number"), text.alias("raw_line"))
    return L.parse_entries(events).select(
        F.col("line_number").alias("event_id"), "level", F.col("ts").isNull().alias("no_time"), "log_format", "message"
    )


@query
def drop_blank_blocks(spark, sf_dir):
    blocks = X.render(X.read_events(spark, sf_dir))
    blank = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, F.lit(" \t\n "))
    blocks = blocks.select(
        F.col("event_id").alias("line_number"), blank.otherwise(F.col("block")).alias("raw_line")
    )
    return L.parse_entries(blocks).select(F.col("line_number").alias("event_id"), "level")


@query
def null_words(spark, sf_dir):
    kind = F.col("event_id") % 7
    message = F.format_string("%s value=%.2f props=%s", "event_type", "value", "props")
    text = (
        F.when(kind == 0, "")
        .when(kind == 1, " -\t")
        .when(kind == 2, "null")
        .when(kind == 3, "\x01N/A\n")
        .otherwise(F.concat(F.lit("\t "), message, F.lit("\r\n")))
    )
    return X.read_events(spark, sf_dir).select("event_id", T.clean(text).alias("cleaned"))


@query
def parse_timestamps(spark, sf_dir):
    """Every event time moved to February 2024: the 30th does not exist."""
    ts = micros(F.col("ts"))
    spaced = F.concat(F.lit("2024-02-"), F.substring(ts, 9, 15))
    nanos = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    iso = F.concat(F.lit("2024-02-"), F.replace(F.substring(ts, 9, 18), F.lit(" "), F.lit("T")), nanos, F.lit("Z"))
    return X.read_events(spark, sf_dir).select(
        "event_id",
        T.ts_text(T.parse_ts(spaced)).alias("spaced"),
        micros(T.parse_iso_ts(iso)).alias("iso"),
        T.iso_nano_rem(iso).alias("nano_rem"),
    )


@query
def has_stack_trace(spark, sf_dir):
    return entries(spark, sf_dir).select(
        F.col("file_offset").alias("event_id"), T.has_stack_trace().alias("has_stack")
    )


@query
def pick_columns(spark, sf_dir):
    return L.pick(entries(spark, sf_dir), ["level", "message"])


# --- structural filters --------------------------------------------------------------------------


def _filtered(name: str, source=entries, shape=brief, **wanted) -> None:
    QUERIES[name] = lambda spark, sf_dir: shape(L.filter_entries(source(spark, sf_dir), **wanted))


_filtered("filter_level", level="error")
_filtered("filter_trace_ids", trace_ids=["tr12", " "], trace_id="tr7")
_filtered("filter_span_ids", span_ids=["sp33"], span_id=" sp9 ,")
_filtered("filter_user", user_id="u1")


@query
def filter_user_case(spark, sf_dir):
    """A user filter minds the case."""
    df = entries(spark, sf_dir)
    found = [L.filter_entries(df, user_id=u).agg(F.lit(u).alias("user_id"), F.count("*").alias("n")) for u in ("U1", "u1")]
    return reduce(DataFrame.unionByName, found)


_filtered("filter_site", site_id="s3")
_filtered("filter_tenant", tenant_id="t2")
_filtered("filter_logger", logger="X.SIGN")
_filtered("filter_message", message="VALUE=1")
_filtered("filter_from", live_entries, placed, from_ts="2024-01-15 06:00:00")
_filtered("filter_to", live_entries, placed, to_ts="2024-01-15 06:00:00")
_filtered("filter_services", services=["svc1", "svc2"])
_filtered(
    "filter_all",
    level="ERROR",
    trace_id="1",
    user_id="u1",
    site_id="s",
    logger="ERROR",
    message="Value=",
    from_ts="2024-01-05 00:00:00",
    to_ts="2024-01-25 00:00:00",
)
_filtered("filter_none", level=" ", user_id="")
_filtered("filter_merged_values", trace_ids=["tr5"], trace_id="tr61 , tr72")


@query
def filter_last_preset(spark, sf_dir):
    return placed(L.last(live_entries(spark, sf_dir), "6h", now="2024-01-29 18:00:00"))


# --- boolean search text -------------------------------------------------------------------------


def _searched(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: brief(L.filter_query(entries(spark, sf_dir), text))


_searched("query_keyword", "PurChase")
_searched("query_phrase", '"5 PROPS"')
_searched("query_phrase_field", '"message:View value=1"')
_searched("query_level", "level:warn")
_searched("query_service", "service:VC1")
_searched("query_user", "user:U1")
_searched("query_site", "siteId:s4")
_searched("query_tenant", "tenant:T0")
_searched("query_trace", "traceid:TR12")
_searched("query_span", "span:sp77")
_searched("query_logger", "class:SignUp")
_searched("query_thread", "thread:POOL-3")
_searched("query_message", "msg:value=2")
_searched("query_unknown_field", "foo:10.12")
_searched("query_blank_value", "level:")
_searched("query_and", "level:ERROR AND pool-2")
_searched("query_or", "level:ERROR or level:DEBUG")
_searched("query_not", "NOT user:u1")
_searched("query_group", "(level:ERROR OR level:WARN) AND thread:pool-1")
_searched("query_left_to_right", "level:ERROR OR level:WARN AND thread:pool-1")
_searched("query_juxtaposed", "level:ERROR pool-2 AND level:INFO")
_searched("query_missing_operand", "level:ERROR AND")
_searched("query_blank", "   ")


@query
def query_documents(spark, sf_dir):
    """The same search text over free text: a document is a block whose message is its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumns({"message": F.col("text"), "raw_line": F.col("text")})
    return L.filter_query(docs, "(LICENSE OR the) AND NOT error").select("doc_id", "lang")


# --- order, cap, pages, window -------------------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    rows = L.numbered(live_entries(spark, sf_dir), X.scratch_dir(spark) + "/sorted", order)
    return placed(rows.withColumn("line_number", F.col("position"))).withColumnRenamed("line_number", "position")


@query
def sort_newest_first(spark, sf_dir):
    return _numbered(spark, sf_dir, "desc")


@query
def sort_oldest_first(spark, sf_dir):
    return _numbered(spark, sf_dir, "asc")


@query
def cap_live(spark, sf_dir):
    return placed(L.cap_entries(live_entries(spark, sf_dir), "desc", 700))


@query
def cap_live_oldest(spark, sf_dir):
    return placed(L.cap_entries(live_entries(spark, sf_dir), "asc", 700))


@query
def cap_rotated(spark, sf_dir):
    return placed(L.cap_entries(live_entries(spark, sf_dir), "desc", 700, keep_null_ts=False))


@query
def page_limit(spark, sf_dir):
    return brief(L.page(entries(spark, sf_dir)))


@query
def page_all(spark, sf_dir):
    return brief(L.page(entries(spark, sf_dir), limit=0))


@query
def next_page(spark, sf_dir):
    return brief(L.page(entries(spark, sf_dir), limit=500, start=500, order="asc"))


@query
def page_past_end(spark, sf_dir):
    df = entries(spark, sf_dir)
    n = df.count()
    pages = {"end": n - 7, "past_end": n + 1}
    counts = [L.page(df, 500, start).agg(F.lit(k).alias("start"), F.count("*").alias("n")) for k, start in pages.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def page_after_key(spark, sf_dir):
    df = entries(spark, sf_dir)
    keys = ("ts", "ts_nano_rem", "service", "file_path", "file_offset")
    seen = L.page(df, limit=500).select(*keys)
    return brief(L.page_after(df, seen.tail(1)[0], limit=500))


@query
def scan_window_last(spark, sf_dir):
    return placed(L.scan_window(live_entries(spark, sf_dir), 900, "desc"))


@query
def scan_window_first(spark, sf_dir):
    return placed(L.scan_window(live_entries(spark, sf_dir), 900, "asc"))


@query
def scan_window_until(spark, sf_dir):
    return placed(L.scan_window(live_entries(spark, sf_dir), 900, "desc", to_ts="2024-01-12 00:00:00"))


@query
def scan_window_since(spark, sf_dir):
    return placed(L.scan_window(live_entries(spark, sf_dir), 900, "asc", from_ts="2024-01-12 00:00:00"))


@query
def cap_then_query(spark, sf_dir):
    return placed(L.filter_query(L.cap_entries(live_entries(spark, sf_dir), "desc", 900), "level:WARN"))


@query
def query_then_cap(spark, sf_dir):
    return placed(L.cap_entries(L.filter_query(live_entries(spark, sf_dir), "level:WARN"), "desc", 900))


# --- counts --------------------------------------------------------------------------------------


def _flat_summary(result: SearchResult) -> DataFrame:
    pairs = F.transform(
        F.map_entries("next_offsets"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return result.summary().withColumn("next_offsets", F.array_join(F.sort_array(pairs), ","))


@query
def next_offsets(spark, sf_dir):
    return L.next_offsets(L.page(live_entries(spark, sf_dir)))


@query
def search_summary(spark, sf_dir):
    return _flat_summary(L.search(spark, live_catalog(spark, sf_dir), level="WARN", cap=1000))


@query
def search_summary_next(spark, sf_dir):
    return _flat_summary(
        L.search(
            spark,
            live_catalog(spark, sf_dir),
            query="thread:pool-1",
            sort_order="asc",
            cap=1000,
            limit=50,
            start=50,
            scan_depth=10**9,
            service_offsets={},
            from_ts="2000-01-01 00:00:00",
        )
    )


# --- searches ------------------------------------------------------------------------------------

SEARCH = {
    "level": "ERROR",
    "user_id": "u1",
    "from_ts": "2024-01-10 00:00:00",
    "to_ts": "2024-01-20 12:00:00",
}


@query
def search_live(spark, sf_dir):
    return placed(L.search(spark, live_catalog(spark, sf_dir), **SEARCH).page)


@query
def search_newest(spark, sf_dir):
    return placed(L.search(spark, live_catalog(spark, sf_dir)).page)


@query
def search_query(spark, sf_dir):
    text = "(level:INFO OR level:WARN) AND message:value=3"
    return placed(L.search(spark, live_catalog(spark, sf_dir), query=text, sort_order="asc").page)


@query
def search_with_depth(spark, sf_dir):
    return placed(L.search(spark, live_catalog(spark, sf_dir), level="DEBUG", scan_depth=400).page)


@query
def search_depth_oldest(spark, sf_dir):
    """The first entries of each service, cut in the scan; the page shows all of them that match."""
    how = {"sort_order": "asc", "scan_depth": 700, "limit": 0}
    return placed(L.search(spark, live_catalog(spark, sf_dir), **how).page)


@query
def log_index(spark, sf_dir):
    """What the side table knows of each file."""
    index = L.read_log_index(spark, index_path(spark, sf_dir))
    return index.groupBy(F.regexp_extract("file_path", r"service=(\w+)/", 1).alias("service"), file_no()).agg(
        F.sum("entries").alias("entries"),
        F.sum("untimed").alias("untimed"),
        F.max("length").alias("n_bytes"),
        micros(F.min("first_ts")).alias("first_ts"),
        micros(F.max("last_ts")).alias("last_ts"),
    )


@query
def search_by_index(spark, sf_dir):
    index = L.read_log_index(spark, index_path(spark, sf_dir))
    return placed(L.search(spark, live_catalog(spark, sf_dir), index=index, **SEARCH).view)


@query
def search_rotated_file(spark, sf_dir):
    result = L.search_file(
        spark, rotated_catalog(spark, sf_dir), "app", "app-week1.log.gz", level="ERROR"
    )
    return result.page.select(T.ts_text(F.col("ts")).alias("ts"), "level", "message")


@query
def search_oldest_forward(spark, sf_dir):
    """Oldest first as a reader goes through a log: blank lines stay, lines before the first entry go."""
    how = {"sort_order": "asc", "keep_blank": True, "keep_orphan": False, "level": "ERROR", "limit": 700}
    page = L.search(spark, live_catalog(spark, sf_dir), **how).page
    return page.select("service", file_no(), "line_number", "file_offset", "raw_line")


@query
def resume_pages(spark, sf_dir):
    """Four pages of services with several files, each from the last entry of the one before."""
    catalog, root = live_catalog(spark, sf_dir), X.scratch_dir(spark)
    scan = L.scan_blocks(spark, catalog).written(f"{root}/scan")
    pages, after = [], None
    for number in range(4):
        found = L.search(spark, catalog, limit=300, after=after, scan=scan).page
        found.write.parquet(f"{root}/page{number}")  # else each page is searched for again
        found = spark.read.schema(found.schema).parquet(f"{root}/page{number}")
        pages.append(placed(found).withColumn("page", F.lit(number)))
        last = L.order_entries(found).tail(1)
        if not last:
            break
        after = last[0]
    return reduce(DataFrame.unionByName, pages)


@query
def search_table(spark, sf_dir):
    return placed(L.search_table(L.read_entries(spark, table_path(spark, sf_dir)), **SEARCH).page)


@query
def table_time_range(spark, sf_dir):
    table = L.read_entries(spark, table_path(spark, sf_dir))
    return placed(L.time_range(table, SEARCH["from_ts"], SEARCH["to_ts"]))


# --- exports -------------------------------------------------------------------------------------


@query
def csv_lines(spark, sf_dir):
    return export.csv_lines(entries(spark, sf_dir))


@query
def csv_field(spark, sf_dir):
    first = F.element_at(
        F.array(*map(F.lit, ("=", "+", "-", "@", "\n", ",", "\r", ""))), F.expr("int(event_id % 8) + 1")
    )
    tail = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("")
    value = F.concat(first, "event_type", tail)
    return X.read_events(spark, sf_dir).select("event_id", export.csv_field(value).alias("field"))


@query
def csv_export(spark, sf_dir):
    path = X.scratch_dir(spark) + "/export"
    L.write_csv(entries(spark, sf_dir), path)
    names = [name for name, _ in P.CSV_COLUMNS]
    schema = ", ".join(f"{name} string" for name in names)
    options = {"multiLine": "true", "quote": '"', "escape": '"', "header": "false", "emptyValue": ""}
    rows = spark.read.schema(schema).options(**options).csv(path)
    # The header is the one record with a name in place of a level; the byte-order mark goes.
    return rows.withColumn("Timestamp", F.translate("Timestamp", "\ufeff", "")).select(
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in names]
    )


@query
def txt_lines(spark, sf_dir):
    return export.entry_text(entries(spark, sf_dir))


@query
def txt_export(spark, sf_dir):
    path = X.scratch_dir(spark) + "/export"
    L.write_txt(entries(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n\n").text(path)


@query
def txt_fallback(spark, sf_dir):
    df = entries(spark, sf_dir).withColumn("raw_line", F.lit(" "))
    return df.select(F.col("file_offset").alias("event_id"), export.text_column().alias("value"))


@query
def json_rows(spark, sf_dir):
    return export.to_json_rows(entries(spark, sf_dir))
