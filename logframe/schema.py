"""The log-entry table: the one schema every operator reads and returns."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_nano_rem", T.IntegerType()),
        T.StructField("level", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("thread", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("file_offset", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("log_format", T.StringType()),
    ]
)

ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

# One physical line of a log file, as the scans return it, without its line end.
LINE_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("split_start", T.LongType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

# One row per configured service.
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("log_file", T.StringType(), False),
        T.StructField("color", T.StringType()),
    ]
)
