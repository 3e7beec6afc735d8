"""Search over service logs as Spark DataFrames."""

from logframe.operators.assemble import assemble_entries
from logframe.operators.filters import filter_entries, last, merge_values, time_range
from logframe.operators.order import (
    cap_entries,
    numbered,
    order_entries,
    page,
    page_after,
    scan_depth,
    scan_window,
)
from logframe.operators.parse import parse_entries, pick
from logframe.operators.query import field, filter_query, kw, query_column
from logframe.operators.summary import next_offsets, offsets_map, search_summary
from logframe.plans.search import SearchRequest, SearchResult, search, search_file, search_table
from logframe.sinks.export import (
    csv_field,
    csv_lines,
    entry_text,
    to_json_rows,
    write_csv,
    write_json,
    write_txt,
)
from logframe.sources.catalog import (
    Service,
    catalog_frame,
    list_log_files,
    list_rotated,
    read_catalog,
    service_catalog,
    service_status,
)
from logframe.sources.log_index import log_index, read_log_index, write_log_index
from logframe.sources.logs import (
    damaged_files,
    damaged_logs,
    read_blocks,
    read_log_lines,
    read_rotated,
    read_service_lines,
    read_services,
    resume,
    scan_blocks,
)
from logframe.sources.table import read_entries, write_entries

__all__ = [name for name in dir() if not name.startswith("_")]
