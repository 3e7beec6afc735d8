"""The expected result of each registered query, stated in SQL straight from the given tables."""

from __future__ import annotations

# Fields of the entry rendered from each event, and the text of its block.
EV = """
ev AS (
  SELECT event_id, event_type, user_id AS uid, event_id % 5 AS f,
    'svc' || (event_id % 3) AS service,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
      WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS level,
    CASE WHEN event_id % 5 = 2 THEN ts ELSE date_trunc('millisecond', ts) END AS ts,
    CASE WHEN event_id % 5 IN (0, 1, 3) THEN 'u' || user_id END AS user_id,
    CASE WHEN event_id % 5 IN (0, 1) OR (event_id % 5 = 3 AND user_id % 2 = 1)
      THEN 's' || (user_id % 7) END AS site_id,
    CASE WHEN event_id % 5 IN (0, 1) OR (event_id % 5 = 3 AND user_id % 2 = 1)
      THEN 't' || (user_id % 3) END AS tenant_id,
    CASE WHEN event_id % 5 <> 2 AND event_id % 11 <> 0 THEN 'tr' || (event_id // 10) END AS trace_id,
    CASE WHEN event_id % 5 <> 2 AND event_id % 11 <> 0 THEN 'sp' || event_id END AS span_id,
    CASE WHEN event_id % 5 <> 2 THEN 'pool-' || (event_id % 8) END AS thread,
    CASE WHEN event_id % 5 <> 2 THEN 'c.x.' || event_type END AS logger,
    event_type || ' value=' || printf('%.2f', value) || ' props=' || props AS message,
    CASE WHEN event_type = 'error' THEN 'java.lang.X: event ' || event_id || chr(10) || chr(9)
      || 'at c.x.Y.run(Y.java:' || event_id || ')' END AS stack_trace,
    CASE event_id % 5 WHEN 0 THEN 'FULL' WHEN 1 THEN 'FULL' WHEN 2 THEN 'ISO' ELSE 'SLIM' END AS log_format,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ms
  FROM events
),
tx AS (
  SELECT *,
    ' [app,' || coalesce(trace_id, '') || ',' || coalesce(span_id, '') || ']' AS ids,
    'u' || uid || ',s' || (uid % 7) || ',t' || (uid % 3) AS triple
  FROM ev
),
en AS (
  SELECT *, first_line || coalesce(chr(10) || stack_trace, '') AS raw_line
  FROM (
    SELECT *,
      CASE f
        WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z main ' || level || ' ' || message
        WHEN 3 THEN ms || ' ' || rpad(level, 5, ' ') || ' ['
          || CASE WHEN uid % 2 = 0 THEN 'u' || uid ELSE triple END || ']' || ids
          || ' [' || thread || '] ' || logger || ' : ' || message
        WHEN 4 THEN ms || ' ' || rpad(level, 5, ' ') || ' []' || ids
          || ' [' || thread || '] ' || logger || ' {:} ' || message
        ELSE CASE WHEN f = 0 THEN chr(27) || '[37m' ELSE '' END || ms || ' host1 '
          || rpad(level, 5, ' ') || ' [' || triple || ']' || ids
          || ' 4242 --- [' || thread || '] ' || logger || ' : ' || message
      END AS first_line
    FROM tx)
)"""

# The same entries as they lie in the log files: one file per service and 5,000 events, led by one
# line without an entry; blank lines inside a block count as bytes and lines of the file.
FILES = (
    EV
    + """,
pl AS (
  SELECT *, event_id // 5000 AS file_no,
    1 + CASE WHEN level = 'ERROR' THEN 2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END AS n_lines,
    strlen(raw_line) + 1 + CASE WHEN level = 'ERROR' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS n_bytes
  FROM en
),
fe AS (
  SELECT service, file_no, event_id, level, ts, log_format, user_id, site_id, tenant_id, trace_id, span_id,
    thread, logger, message, stack_trace, raw_line, n_lines, n_bytes,
    1 + CAST(coalesce(sum(n_lines) OVER w, 0) AS BIGINT) + 1 AS line_number,
    16 + CAST(coalesce(sum(n_bytes) OVER w, 0) AS BIGINT) AS file_offset,
    CAST(1 + coalesce(count(*) OVER w, 0) AS BIGINT) AS entry_seq
  FROM pl
  WINDOW w AS (PARTITION BY service, file_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT service, file_no, NULL, 'UNKNOWN', NULL, 'RAW', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    'log file opened', NULL, 'log file opened', 1, 16, 1, 0, 0
  FROM pl GROUP BY service, file_no
)"""
)

MS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"
BRIEF = "event_id, service, level, message"
LIVE = f"service, CAST(file_no AS BIGINT) AS file_no, line_number, file_offset, {MS} AS ts, level, message"
NEWEST = "ts DESC NULLS LAST, service, file_no, file_offset"
OLDEST = "ts ASC NULLS LAST, service, file_no, file_offset"
E_NEWEST = "ts DESC NULLS LAST, service, event_id"
E_OLDEST = "ts ASC NULLS LAST, service, event_id"


def ev(select: str) -> str:
    return f"WITH {EV}\n{select}"


def files(select: str) -> str:
    return f"WITH {FILES}\n{select}"


def kept(where: str) -> str:
    return ev(f"SELECT {BRIEF} FROM en WHERE {where}")


def live(where: str) -> str:
    return files(f"SELECT {LIVE} FROM fe WHERE {where}")


def word(text: str) -> str:
    """A keyword test as SQL: message or block, without regard to case."""
    return f"(contains(lower(message), '{text}') OR contains(lower(raw_line), '{text}'))"


def has(column: str, text: str) -> str:
    return f"coalesce(contains(lower({column}), '{text}'), false)"


ROTATED_NAME = """CASE WHEN day(events.ts) >= 22 THEN 'app.log' WHEN day(events.ts) >= 15 THEN 'app.log.1'
  WHEN day(events.ts) >= 8 THEN 'app.log.2.gz' ELSE 'app-week1.log.gz' END"""

PARSED = (
    "event_id, service, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, 0 AS ts_nano_rem, level, user_id, site_id,"
    " tenant_id, trace_id, span_id, logger, thread, message, stack_trace, raw_line, log_format"
)

CSV_ROW = """concat_ws(',', coalesce({ms}, ''), level, service, coalesce(logger, ''), coalesce(thread, ''),
  coalesce(trace_id, ''), coalesce(span_id, ''), coalesce(user_id, ''), coalesce(site_id, ''),
  coalesce(tenant_id, ''), CASE WHEN contains(message, '"') THEN '"' || replace(message, '"', '""') || '"'
  ELSE message END, CASE WHEN stack_trace IS NULL THEN '' ELSE '"' || stack_trace || '"' END)"""


def _json(name: str, column: str) -> str:
    return f"coalesce(',\"{name}\":' || CAST(to_json({column}) AS VARCHAR), '')"


JSON_ROW = (
    "'{' || substr("
    + " || ".join(
        [_json("service", "service"), _json("timestamp", MS)]
        + [
            _json(n, c)
            for n, c in [
                ("level", "level"),
                ("userId", "user_id"),
                ("siteId", "site_id"),
                ("tenantId", "tenant_id"),
                ("traceId", "trace_id"),
                ("spanId", "span_id"),
                ("logger", "logger"),
                ("thread", "thread"),
                ("message", "message"),
                ("stackTrace", "stack_trace"),
                ("rawLine", "raw_line"),
            ]
        ]
    )
    + " || ',\"lineNumber\":' || event_id, 2) || '}'"
)

CLEANED = "CASE WHEN event_id % 7 IN (0, 1, 2, 3) THEN NULL ELSE message END"

IS_WARN = "level = 'WARN'"

SEARCH_FILTER = """level = 'ERROR' AND contains(user_id, 'u1')
  AND (ts IS NULL OR ts >= TIMESTAMP '2024-01-10 00:00:00') AND (ts IS NULL OR ts <= TIMESTAMP '2024-01-20 12:00:00')"""


def _capped(k: int, where: str = "true", order: str = NEWEST) -> str:
    """The first k entries with a time, and all without one."""
    timed = f"(SELECT * FROM fe WHERE {where} AND ts IS NOT NULL ORDER BY {order} LIMIT {k})"
    return f"(SELECT * FROM {timed} UNION ALL SELECT * FROM fe WHERE {where} AND ts IS NULL)"


def _numbered(order: str) -> str:
    return files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, file_offset, level, message,"
        f" row_number() OVER (ORDER BY {order}) - 1 AS position, {MS} AS ts FROM fe"
    )


def _summary(structural: str, view: str, limit: int, start: int, order: str) -> str:
    edge, keys = ("max", OLDEST) if order == "asc" else ("min", NEWEST)
    return files(f"""
    , v AS (SELECT * FROM {view}),
    p AS (SELECT * FROM v ORDER BY {keys} LIMIT {limit} OFFSET {start}),
    s AS (SELECT * FROM v ORDER BY {keys} LIMIT {start + limit})
    SELECT (SELECT count(*) FROM v) AS total_matched,
      (SELECT count(*) FROM fe WHERE {structural}) AS filtered_by_structured,
      {limit} AS page_limit, '{order}' AS sort_order,
      (SELECT string_agg(service || '=' || o, ',' ORDER BY service)
        FROM (SELECT service, {edge}(file_offset) AS o FROM s GROUP BY service)) AS next_offsets,
      (SELECT {start} + (SELECT count(*) FROM p) < (SELECT count(*) FROM v)) AS has_more""")


ORACLES: dict[str, str] = {
    # sources
    "text_log_scan": files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, CAST(sum(n_lines) AS BIGINT) AS n_lines,"
        " CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(count(*) AS BIGINT) - 1 AS n_entries"
        " FROM fe GROUP BY service, file_no"
    ),
    "gzip_log_scan": ev(
        f"SELECT {ROTATED_NAME} AS log, CAST(sum(1 + CASE WHEN level = 'ERROR' THEN 2 + "
        "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS n_lines"
        " FROM en JOIN events USING (event_id) GROUP BY ALL"
    ),
    "multi_service_scan": live("service IN ('svc2', 'svc0')"),
    "service_catalog": ev(
        "SELECT s.name, s.color, count(en.event_id) AS n_entries FROM (VALUES ('svc0', NULL),"
        " ('svc1', NULL), ('svc2', NULL)) s(name, color) LEFT JOIN en ON en.service = s.name GROUP BY ALL"
    ),
    "service_status": files(
        "SELECT service AS name, '#1a6fa3' AS color, true AS \"exists\","
        " CAST(sum(n_bytes) // 1024 AS BIGINT) AS size_kb, true AS has_time, count(event_id) AS n_entries"
        " FROM fe GROUP BY service"
        " UNION ALL SELECT 'absent', '#00ff00', false, 0, false, 0"
    ),
    "list_rotated": files(
        "SELECT name, CASE WHEN name LIKE '%.gz' THEN 0 ELSE CAST((sum(n_bytes) + 1023) // 1024 AS BIGINT) END AS size_kb,"
        f" true AS in_order, count(*) AS n_entries FROM (SELECT {ROTATED_NAME} AS name, n_bytes"
        " FROM pl JOIN events USING (event_id) WHERE day(events.ts) < 22) GROUP BY name"
    ),
    "rotated_file_scan": ev(
        f"SELECT 'app' AS service, {ROTATED_NAME} AS log, {MS.replace('(ts', '(en.ts')} AS ts, level,"
        " en.user_id, message, stack_trace FROM en JOIN events USING (event_id)"
    ),
    "resume_newest_first": live(
        "file_offset < CASE service WHEN 'svc0' THEN 100000 WHEN 'svc1' THEN 5000 ELSE 70000 END"
    ),
    "resume_oldest_first": live(
        "service = 'svc2' OR file_offset > CASE service WHEN 'svc0' THEN 100000 ELSE 5000 END"
    ),
    # assembly
    "new_entry_test": ev(
        "SELECT service, log_format, CAST(count(*) AS BIGINT) AS n_new, CAST(sum(CASE WHEN level = 'ERROR' THEN 2 +"
        " CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS n_other FROM en GROUP BY ALL"
    ),
    "assemble_blocks": files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, entry_seq, line_number, file_offset,"
        " raw_line FROM fe"
    ),
    "assemble_keep_blank": files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, entry_seq, line_number, file_offset,"
        " CASE WHEN level = 'ERROR' AND event_id % 2 = 0 THEN replace(raw_line, chr(10) || chr(9),"
        " chr(10) || chr(10) || chr(9)) ELSE raw_line END AS raw_line FROM fe WHERE entry_seq > 0"
    ),
    "orphan_heads": live("event_id IS NULL"),
    # parsing
    "parse_formats": ev(f"SELECT {PARSED} FROM en"),
    "strip_ansi": ev("SELECT event_id, replace(first_line, chr(27) || '[37m', '') AS line FROM en"),
    "split_block": ev("SELECT event_id, first_line, stack_trace FROM en"),
    "split_context": ev(
        "SELECT event_id, CASE WHEN f <> 4 THEN 'u' || uid END AS user_id, CASE WHEN f IN (0, 1) THEN"
        " 's' || (uid % 7) WHEN f = 2 THEN 's' END AS site_id, CASE WHEN f IN (0, 1) THEN"
        " 't' || (uid % 3) || CASE f WHEN 1 THEN ',x' ELSE '' END END AS tenant_id FROM ev"
    ),
    "simple_fallback": ev(
        "SELECT event_id, CASE WHEN level IN ('INFO', 'WARN') THEN 'SIMPLE' ELSE 'FULL' END AS log_format,"
        " level, CASE WHEN level NOT IN ('INFO', 'WARN') THEN 'u' || uid END AS user_id,"
        " CASE WHEN level IN ('INFO', 'WARN') THEN '[' || triple || '] [app,,] 1 --- [main] c.X : ' || message"
        " ELSE message END AS message FROM tx"
    ),
    "raw_fallback": ev(
        "SELECT event_id, 'UNKNOWN' AS level, true AS no_time, 'RAW' AS log_format, '  ' || message || ' ' AS message"
        " FROM ev"
    ),
    "drop_blank_blocks": ev("SELECT event_id, level FROM ev WHERE event_id % 4 >= 2"),
    "null_words": ev(f"SELECT event_id, {CLEANED} AS cleaned FROM ev"),
    "parse_timestamps": ev(
        "SELECT event_id, CASE WHEN day(ts) <= 29 THEN '2024-02-' || strftime(ts, '%d %H:%M:%S.%g') END AS spaced,"
        " CASE WHEN day(ts) <= 29 THEN '2024-02-' || strftime(ts, '%d %H:%M:%S.%f') END AS iso,"
        " CAST(event_id % 1000 AS INTEGER) AS nano_rem"
        " FROM (SELECT event_id, ts FROM events)"
    ),
    "has_stack_trace": ev("SELECT event_id, level = 'ERROR' AS has_stack FROM ev"),
    "pick_columns": ev("SELECT level, message FROM ev"),
    # structural filters
    "filter_level": kept("level = 'ERROR'"),
    "filter_trace_ids": kept("contains(trace_id, 'tr12') OR contains(trace_id, 'tr7')"),
    "filter_span_ids": kept("contains(span_id, 'sp33') OR contains(span_id, 'sp9')"),
    "filter_user": kept("contains(user_id, 'u1')"),
    "filter_user_case": ev(
        "SELECT u AS user_id, count(event_id) AS n FROM (VALUES ('U1'), ('u1')) w(u)"
        " LEFT JOIN en ON contains(en.user_id, u) GROUP BY u"
    ),
    "filter_site": kept("contains(site_id, 's3')"),
    "filter_tenant": kept("contains(tenant_id, 't2')"),
    "filter_logger": kept("contains(lower(logger), 'x.sign')"),
    "filter_message": kept("contains(lower(message), 'value=1')"),
    "filter_from": live("ts IS NULL OR ts >= TIMESTAMP '2024-01-15 06:00:00'"),
    "filter_to": live("ts IS NULL OR ts <= TIMESTAMP '2024-01-15 06:00:00'"),
    "filter_services": kept("service IN ('svc1', 'svc2')"),
    "filter_all": kept(
        "level = 'ERROR' AND contains(trace_id, '1') AND contains(user_id, 'u1') AND contains(site_id, 's')"
        " AND contains(lower(logger), 'error') AND contains(lower(message), 'value=')"
        " AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'"
    ),
    "filter_none": kept("true"),
    "filter_merged_values": kept(
        "contains(trace_id, 'tr5') OR contains(trace_id, 'tr61') OR contains(trace_id, 'tr72')"
    ),
    "filter_last_preset": live("ts IS NULL OR ts >= TIMESTAMP '2024-01-29 12:00:00'"),
    # boolean search text
    "query_keyword": kept(word("purchase")),
    "query_phrase": kept(word("5 props")),
    "query_phrase_field": kept(has("message", "view value=1")),
    "query_level": kept("level = 'WARN'"),
    "query_service": kept(has("service", "vc1")),
    "query_user": kept(has("user_id", "u1")),
    "query_site": kept(has("site_id", "s4")),
    "query_tenant": kept(has("tenant_id", "t0")),
    "query_trace": kept(has("trace_id", "tr12")),
    "query_span": kept(has("span_id", "sp77")),
    "query_logger": kept(has("logger", "signup")),
    "query_thread": kept(has("thread", "pool-3")),
    "query_message": kept(has("message", "value=2")),
    "query_unknown_field": kept(word("10.12")),
    "query_blank_value": kept("true"),
    "query_and": kept(f"level = 'ERROR' AND {word('pool-2')}"),
    "query_or": kept("level = 'ERROR' OR level = 'DEBUG'"),
    "query_not": kept(f"NOT {has('user_id', 'u1')}"),
    "query_group": kept(f"(level = 'ERROR' OR level = 'WARN') AND {has('thread', 'pool-1')}"),
    "query_left_to_right": kept(f"(level = 'ERROR' OR level = 'WARN') AND {has('thread', 'pool-1')}"),
    "query_juxtaposed": kept("level = 'ERROR'"),
    "query_missing_operand": kept("level = 'ERROR'"),
    "query_blank": kept("true"),
    "query_documents": (
        "SELECT doc_id, lang FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'the'))"
        " AND NOT contains(lower(text), 'error')"
    ),
    # order, cap, pages, window
    "sort_newest_first": _numbered(NEWEST),
    "sort_oldest_first": _numbered(OLDEST),
    "cap_live": files(f"SELECT {LIVE} FROM {_capped(700)}"),
    "cap_live_oldest": files(f"SELECT {LIVE} FROM {_capped(700, order=OLDEST)}"),
    "cap_rotated": files(f"SELECT {LIVE} FROM (SELECT * FROM fe ORDER BY {NEWEST} LIMIT 700)"),
    "page_limit": ev(f"SELECT {BRIEF} FROM en ORDER BY {E_NEWEST} LIMIT 500"),
    "page_all": ev(f"SELECT {BRIEF} FROM en ORDER BY {E_NEWEST}"),
    "next_page": ev(f"SELECT {BRIEF} FROM en ORDER BY {E_OLDEST} LIMIT 500 OFFSET 500"),
    "page_past_end": ev(
        "SELECT 'end' AS \"start\", CAST(7 AS BIGINT) AS n UNION ALL SELECT 'past_end', 0 WHERE (SELECT count(*) FROM en) > 7"
    ),
    "page_after_key": ev(f"SELECT {BRIEF} FROM en ORDER BY {E_NEWEST} LIMIT 500 OFFSET 500"),
    "scan_window_last": files(
        f"SELECT {LIVE} FROM fe QUALIFY row_number() OVER (PARTITION BY service"
        " ORDER BY file_no DESC, file_offset DESC) <= 900"
    ),
    "scan_window_first": files(
        f"SELECT {LIVE} FROM fe QUALIFY row_number() OVER (PARTITION BY service"
        " ORDER BY file_no, file_offset) <= 900"
    ),
    "scan_window_until": files(
        f"SELECT {LIVE} FROM fe WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-12 00:00:00'"
        " QUALIFY row_number() OVER (PARTITION BY service ORDER BY file_no DESC, file_offset DESC) <= 900"
    ),
    "scan_window_since": files(
        f"SELECT {LIVE} FROM fe WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-12 00:00:00'"
        " QUALIFY row_number() OVER (PARTITION BY service ORDER BY file_no, file_offset) <= 900"
    ),
    "cap_then_query": files(f"SELECT {LIVE} FROM {_capped(900)} WHERE level = 'WARN'"),
    "query_then_cap": files(f"SELECT {LIVE} FROM {_capped(900, IS_WARN)}"),
    # counts
    "next_offsets": files(
        f"SELECT service, min(file_offset) AS next_offset FROM (SELECT * FROM fe ORDER BY {NEWEST} LIMIT 500)"
        " GROUP BY service"
    ),
    "search_summary": _summary("level = 'WARN'", _capped(1000, "level = 'WARN'"), 500, 0, "desc"),
    "search_summary_next": _summary("true", _capped(1000, has("thread", "pool-1"), OLDEST), 50, 50, "asc"),
    # searches
    "search_live": files(f"SELECT {LIVE} FROM fe WHERE {SEARCH_FILTER} ORDER BY {NEWEST} LIMIT 500"),
    "search_newest": files(f"SELECT {LIVE} FROM fe ORDER BY {NEWEST} LIMIT 500"),
    "search_query": files(
        f"SELECT {LIVE} FROM fe WHERE (level = 'INFO' OR level = 'WARN') AND {has('message', 'value=3')}"
        f" ORDER BY {OLDEST} LIMIT 500"
    ),
    "search_with_depth": files(
        f"SELECT {LIVE} FROM (SELECT * FROM fe QUALIFY row_number() OVER (PARTITION BY service"
        f" ORDER BY file_no DESC, file_offset DESC) <= 400) WHERE level = 'DEBUG' ORDER BY {NEWEST} LIMIT 500"
    ),
    "search_depth_oldest": files(
        f"SELECT {LIVE} FROM fe QUALIFY row_number() OVER (PARTITION BY service ORDER BY file_no, file_offset) <= 700"
    ),
    "log_index": files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, CAST(count(*) AS BIGINT) AS entries,"
        " CAST(count(*) - count(ts) AS BIGINT) AS untimed, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,"
        " strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts"
        " FROM fe GROUP BY service, file_no"
    ),
    "search_by_index": files(f"SELECT {LIVE} FROM fe WHERE {SEARCH_FILTER}"),
    "search_rotated_file": ev(
        f"SELECT {MS} AS ts, level, message FROM (SELECT en.* FROM en JOIN (SELECT event_id, ts AS logged FROM events)"
        f" USING (event_id) WHERE day(logged) < 8 AND level = 'ERROR') ORDER BY {E_NEWEST} LIMIT 500"
    ),
    "search_oldest_forward": files(
        "SELECT service, CAST(file_no AS BIGINT) AS file_no, line_number, file_offset,"
        " CASE WHEN event_id % 2 = 0 THEN replace(raw_line, chr(10) || chr(9), chr(10) || chr(10) || chr(9))"
        f" ELSE raw_line END AS raw_line FROM fe WHERE level = 'ERROR' ORDER BY {OLDEST} LIMIT 700"
    ),
    "resume_pages": files(
        f"SELECT {LIVE}, CAST((row_number() OVER (ORDER BY {NEWEST}) - 1) // 300 AS INTEGER) AS page"
        f" FROM fe QUALIFY page < 4"
    ),
    "search_table": files(f"SELECT {LIVE} FROM fe WHERE {SEARCH_FILTER} ORDER BY {NEWEST} LIMIT 500"),
    "table_time_range": live(
        "ts IS NULL OR (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00')"
    ),
    # exports
    "csv_lines": ev(f"SELECT {CSV_ROW.format(ms=MS)} AS value FROM en"),
    "csv_field": (
        "SELECT event_id, CASE WHEN contains(v, ',') OR contains(v, '\"') OR contains(v, chr(10))"
        " OR contains(v, chr(13)) THEN '\"' || replace(g, '\"', '\"\"') || '\"' ELSE g END AS field"
        " FROM (SELECT event_id, v, CASE WHEN v[1:1] IN ('=', '+', '-', '@') THEN chr(9) || v ELSE v END AS g FROM"
        " (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@'"
        " WHEN 4 THEN chr(10) WHEN 5 THEN ',' WHEN 6 THEN chr(13) ELSE '' END || event_type ||"
        " CASE WHEN event_id % 3 = 0 THEN props ELSE '' END AS v FROM events))"
    ),
    "csv_export": ev(
        "SELECT "
        + ", ".join(
            f"coalesce({MS if c == 'ts' else c}, '') AS \"{n}\""
            for n, c in [
                ("Timestamp", "ts"), ("Level", "level"), ("Service", "service"), ("Logger", "logger"),
                ("Thread", "thread"), ("TraceId", "trace_id"), ("SpanId", "span_id"), ("UserId", "user_id"),
                ("SiteId", "site_id"), ("TenantId", "tenant_id"), ("Message", "message"), ("StackTrace", "stack_trace"),
            ]
        )
        + " FROM en UNION ALL SELECT 'Timestamp', 'Level', 'Service', 'Logger', 'Thread', 'TraceId', 'SpanId',"
        " 'UserId', 'SiteId', 'TenantId', 'Message', 'StackTrace'"
    ),
    "txt_lines": ev("SELECT raw_line AS value FROM en"),
    "txt_export": ev("SELECT raw_line AS value FROM en"),
    "txt_fallback": ev(
        "SELECT event_id, iso || ' ' || level || ' [' || coalesce(thread, '') || '] ' || coalesce(logger, '') || ' - '"
        " || message || coalesce(chr(10) || stack_trace, '') AS value FROM (SELECT *,"
        " CASE WHEN microsecond(ts) % 1000000 = 0 AND second(ts) = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M')"
        " WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')"
        " WHEN microsecond(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')"
        " ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM ev)"
    ),
    "json_rows": ev(f"SELECT {JSON_ROW} AS value FROM en"),
}
