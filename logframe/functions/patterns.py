"""The line formats of the logs this library reads.

The five patterns, the level names, the blank markers and the limits must stay exactly as they are:
they decide which rows a search returns. Everything else in the package is built on top of them.
"""

# --- fixed values -------------------------------------------------------------------------------

# ESC [ digits letter: colour and cursor codes, removed before a line is matched.
ANSI_CODE = "\\u001B\\[[;\\d]*[A-Za-z]"

# A line that opens an entry: any leading ESC...m runs, then a timestamp-shaped prefix.
NEW_ENTRY = r"(?s)^(?:\x1B[^m]*m)*\p{Nd}.{3}-.{2}-.{2}[ T].{2}:.{2}:.{2}\..{3}"

_SPACE_TS = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})"
_PADDED_LEVEL = r"(ERROR|WARN |INFO |DEBUG|TRACE)"
_LEVEL = r"(ERROR|WARN|INFO|DEBUG|TRACE)"
_TRIPLE = r"\[([^,\]]*),([^,\]]*),([^\]]*)\]"
_THREAD = r"\[([^\[]+)\]+"
_TAIL = r"\s+(\S+)\s+\{?:\}?\s+(.*)"

# ts host LEVEL [user,site,tenant] [app,trace,span] pid --- [thread] logger : message
FULL = rf"(?s)^{_SPACE_TS}\s+(\S+)\s+{_PADDED_LEVEL}\s+{_TRIPLE}\s+{_TRIPLE}\s+\S+\s+---\s+{_THREAD}{_TAIL}"
# ts LEVEL [context] [app,trace,span] [thread] logger : message
SLIM = rf"(?s)^{_SPACE_TS}\s+{_PADDED_LEVEL}\s+\[([^\]]*)\]\s+{_TRIPLE}\s+{_THREAD}{_TAIL}"
# ts [one token] LEVEL message
SIMPLE = rf"(?s)^{_SPACE_TS}(?:\s+\S+)?\s+{_LEVEL}\s+(.*)"
# ISO ts, thread token, LEVEL message
ISO = rf"(?s)^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d+Z?)\s+\S+\s+{_LEVEL}\s+(.*)"

UNKNOWN_LEVEL = "UNKNOWN"
NULL_WORDS = ("", "-", "null", "N/A")

DEFAULT_COLOR = "#1a6fa3"
DEFAULT_PAGE = 500

CSV_COLUMNS = (
    ("Timestamp", "ts"),
    ("Level", "level"),
    ("Service", "service"),
    ("Logger", "logger"),
    ("Thread", "thread"),
    ("TraceId", "trace_id"),
    ("SpanId", "span_id"),
    ("UserId", "user_id"),
    ("SiteId", "site_id"),
    ("TenantId", "tenant_id"),
    ("Message", "message"),
    ("StackTrace", "stack_trace"),
)

JSON_COLUMNS = (
    ("service", "service"),
    ("timestamp", "ts"),
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
    ("lineNumber", "line_number"),
)

# --- character classes of the JVM the logs were written for --------------------------------------

# Characters removed by a plain trim: everything up to and including U+0020.
TRIM_CHARS = "".join(chr(c) for c in range(0x21))
# Characters that count as white space when a line or a text is tested for being blank.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\u1680" + (
    "".join(chr(c) for c in range(0x2000, 0x200B) if c != 0x2007) + "\u2028\u2029\u205f\u3000"
)
