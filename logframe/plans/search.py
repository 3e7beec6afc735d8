"""Searches: the operators composed in the one order that fixes the answers.

scan, assemble, parse, scan window, structural filters, search text, cap, order, page. Nothing is cut
unless the request asks for it. To apply a search text behind a cap, compose ``cap_entries`` and
``filter_query``; the two do not commute.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.operators import order as O
from logframe.operators.filters import Moment, filter_entries, filters_on_block, is_set, merge_values
from logframe.operators.parse import parse_entries
from logframe.operators.query import filter_query, query_column, query_on_block
from logframe.operators.scan import BlockScan
from logframe.operators.summary import next_offsets, search_summary, summary_row
from logframe.sources import logs
from logframe.sources.catalog import Catalog, list_log_files, resolve_services
from logframe.sources.log_index import blocks_in_range


@dataclass(frozen=True)
class SearchRequest:
    """What to search for.

    ``scan_depth`` looks at so many entries per service, ``cap`` keeps so many of the view, ``limit`` shows so
    many of the page; None or 0 of either means all. ``after`` goes on behind the last entry served.
    ``keep_blank`` and ``keep_orphan`` are those of the assembly of raw logs. A log that cannot be read to its end fails
    the search; with ``skip_damaged`` it gives what lies before the damage, and ``SearchResult.damaged`` names it.
    """

    services: tuple[str, ...] = ()
    level: str | None = None
    trace_ids: tuple[str, ...] = ()
    trace_id: str | None = None
    span_ids: tuple[str, ...] = ()
    span_id: str | None = None
    user_id: str | None = None
    site_id: str | None = None
    tenant_id: str | None = None
    logger: str | None = None
    message: str | None = None
    query: str | None = None
    from_ts: Moment | None = None
    to_ts: Moment | None = None
    limit: int | None = P.DEFAULT_PAGE
    start: int = 0
    sort_order: str = "desc"
    scan_depth: int | None = None
    cap: int | None = None
    after: Row | Mapping | None = None
    keep_blank: bool = False
    keep_orphan: bool = True
    skip_damaged: bool = False
    file_offset: int | None = None
    service_offsets: Mapping[str, int] | None = None

    @property
    def depth(self) -> int | None:
        return O.scan_depth(self.scan_depth)

    @property
    def resumes(self) -> bool:
        """Whether byte cursors say where to go on."""
        return bool(self.service_offsets) or self.file_offset is not None

    @property
    def filtered(self) -> bool:
        """Whether anything but the time range narrows the search."""
        texts = (self.level, self.user_id, self.site_id, self.tenant_id, self.logger, self.message)
        ids = merge_values(self.trace_ids, self.trace_id) + merge_values(self.span_ids, self.span_id)
        return bool(ids) or is_set(self.query) or any(is_set(t) for t in texts)

    def reading(self) -> dict[str, bool]:
        return {"keep_blank": self.keep_blank, "keep_orphan": self.keep_orphan, "skip_damaged": self.skip_damaged}

    def structural(self) -> dict:
        names = (
            "level trace_ids trace_id span_ids span_id user_id site_id tenant_id logger message from_ts to_ts"
        )
        return {name: getattr(self, name) for name in names.split()}


@dataclass(frozen=True)
class SearchResult:
    """The lazy parts of a search. Persist ``structural`` to refine the query without a new scan."""

    spark: SparkSession
    request: SearchRequest
    structural: DataFrame
    view: DataFrame
    page: DataFrame
    keep_null_ts: bool = True
    #: The services whose raw logs were read.
    catalog: Catalog = ()

    @property
    def damaged(self) -> DataFrame:
        """Service and file of the logs that the search could not read to their end; each gzip log is read for it."""
        return logs.damaged_logs(self.spark, self.catalog)

    @property
    def _served(self) -> int | None:
        """Entries up to the end of the page; None for all."""
        size = O.page_size(self.request.limit)
        return None if size is None else self.request.start + size

    @property
    def _one_pass(self) -> bool:
        """Whether the first entries of the view are those of all matches, so that a cap only changes counts."""
        cap = self.request.cap
        return cap is None or (self._served is not None and self._served <= cap)

    def _counts(self) -> list[Column]:
        text, timed = self.request.query, F.col("ts").isNotNull()
        matched = query_column(text) if is_set(text) else F.lit(True)
        return [F.count(F.lit(1)).alias("all"), F.count_if(matched & timed).alias("timed"), F.count_if(matched & ~timed).alias("untimed")]

    def _watched(self) -> tuple[Observation, DataFrame]:
        """The matches, and the counts that any job over them brings along."""
        seen = Observation()
        return seen, filter_query(self.structural.observe(seen, *self._counts()), self.request.query)

    def _counted(self, seen: Observation, offsets: Mapping[str, int]) -> DataFrame:
        cap = self.request.cap
        try:
            found = seen.get
        except Py4JJavaError:  # a plan that is known to be empty has nothing to observe
            found = self.structural.agg(*self._counts()).first()
        total = found["timed"] + found["untimed"]
        if cap is not None:
            total = min(found["timed"], cap) + found["untimed"] if self.keep_null_ts else min(total, cap)
        return summary_row(self.spark, total, found["all"], O.page_size(self.request.limit), self.request.start, self.request.sort_order, offsets)

    def summary(self) -> DataFrame:
        """Counts, resume positions and whether there is more, as one row; one scan, unless a cap ends inside the page."""
        req = self.request
        if self._one_pass:
            seen, rows = self._watched()
            served = rows if self._served is None else O.page(rows, self._served, 0, req.sort_order)
            offsets = next_offsets(served, req.sort_order).collect()  # a row for each service
            return self._counted(seen, {r[0]: r[1] for r in offsets})
        served = O.page(self.view, self._served, 0, req.sort_order)
        return search_summary(
            self.structural,
            self.page,
            matched=query_column(req.query) if is_set(req.query) else F.lit(True),
            cap=req.cap,
            keep_null_ts=self.keep_null_ts,
            limit=O.page_size(req.limit),
            start=req.start,
            order=req.sort_order,
            served=served if req.start else None,
        )

    def fetch(self) -> tuple[list[Row], DataFrame]:
        """The rows of the page and its summary, from one job. For pages with a limit."""
        req = self.request
        if self._served is None:
            raise ValueError("fetch needs a limit; read view for all entries")
        if not self._one_pass:
            return self.page.collect(), self.summary()
        seen, found = self._watched()
        rows = O.page(found, self._served, 0, req.sort_order).collect()
        edge, offsets = (max if O.is_asc(req.sort_order) else min), {}
        for r in rows:
            if r["service"] is not None and r["file_offset"] is not None:
                offsets[r["service"]] = edge(offsets.get(r["service"], r["file_offset"]), r["file_offset"])
        return rows[req.start :], self._counted(seen, offsets)


def windowed(entries: DataFrame, req: SearchRequest, streamed: bool = False) -> DataFrame:
    """The entries a search looks at: past its cursors and inside its scan depth."""
    if req.resumes:
        entries = logs.resume(entries, req.service_offsets or {}, req.sort_order, default=req.file_offset)
    if req.depth is None:
        return entries
    return O.scan_window(
        entries,
        req.depth,
        req.sort_order,
        from_ts=req.from_ts,
        to_ts=req.to_ts,
        filtered=req.filtered,
        streamed=streamed,
    )


def _scanned(spark: SparkSession, services: Catalog, req: SearchRequest, streamed: bool = False) -> DataFrame:
    """The parsed entries a search of raw logs looks at.

    A window that depends on nothing but the place in the log is cut in the scan.
    """
    if req.resumes:
        listed = list_log_files(spark, services).filter("length > 0")
        logs.check_cursors(listed, req.service_offsets or {}, req.file_offset)
    scan = logs.scan_blocks(spark, services, **req.reading())
    by_time = not streamed and O.bounded_by_time(req.sort_order, req.from_ts, req.to_ts)
    if req.depth is None or by_time or req.resumes:
        return windowed(parse_entries(scan.blocks()), req, streamed)
    asc = O.is_asc(req.sort_order)
    oldest = streamed or (asc and (req.to_ts is not None or not req.filtered))
    return parse_entries(scan.blocks(scan.window(req.depth, oldest)))


def search_entries(
    entries: DataFrame,
    req: SearchRequest,
    *,
    keep_null_ts: bool = True,
    bounded: bool = True,
    parsing: bool = False,
    catalog: Catalog = (),
) -> SearchResult:
    """Filter, cap, order and page entries that already passed the scan window.

    With ``parsing`` the entries come straight from the parser: what the filters imply for the raw
    block is tested as well, a test that Catalyst moves below the parser.
    """
    filters = req.structural()
    first = entries.filter(filters_on_block(**filters)) if parsing else entries
    structural = filter_entries(first, services=req.services, **filters)
    if req.after is not None:
        structural = structural.filter(O.past_row(req.after, req.sort_order))
    wanted = structural.filter(query_on_block(req.query)) if parsing else structural
    wanted = filter_query(wanted, req.query)
    view = O.cap_entries(wanted, req.sort_order, req.cap, keep_null_ts=keep_null_ts, bounded=bounded)
    page = O.page(view, req.limit, req.start, req.sort_order)
    return SearchResult(entries.sparkSession, req, structural, view, page, keep_null_ts, catalog)


def search(
    spark: SparkSession,
    catalog: Catalog,
    *,
    bounded: bool = True,
    index: DataFrame | None = None,
    scan: BlockScan | None = None,
    **request,
) -> SearchResult:
    """Search the active logs of the services.

    ``bounded`` finds the last time of a cap in a pass of its own. ``index`` (``read_log_index``) tells where a time
    range is; a search with a scan depth or byte cursors does not use it. The answer is the same either way.
    ``scan`` (``scan_blocks`` of the same services, ``written``) saves the second and later searches of unchanged logs
    their listing and the pass over the edges; a search with an index, a scan depth or byte cursors does not use it.
    """
    req = SearchRequest(**request)
    chosen = resolve_services(catalog, req.services)
    if scan is not None and (scan.keep_blank, scan.keep_orphan) != (req.keep_blank, req.keep_orphan):
        raise ValueError("The scan keeps other lines than the search asks for")
    ranged = req.from_ts is not None or req.to_ts is not None
    if index is not None and ranged and req.depth is None and not req.resumes:
        blocks = blocks_in_range(spark, chosen, index, req.from_ts, req.to_ts, **req.reading())
        return search_entries(parse_entries(blocks), req, bounded=bounded, parsing=True, catalog=chosen)
    if scan is not None and req.depth is None and not req.resumes:
        return search_entries(parse_entries(scan.blocks()), req, bounded=bounded, parsing=True, catalog=chosen)
    streamed = tuple(s for s in chosen if s.log_file.endswith(".gz"))
    plain = tuple(s for s in chosen if s not in streamed)
    # With a depth, gzip logs are read from their start and plain ones from the wanted end.
    groups = [(chosen, False)] if req.depth is None else [(plain, False), (streamed, True)]
    parts = [
        _scanned(spark, group, req, gz) for group, gz in groups if group or not chosen
    ]
    entries = reduce(DataFrame.unionByName, parts)
    return search_entries(entries, req, bounded=bounded, parsing=req.depth is None, catalog=chosen)


def search_table(entries: DataFrame, *, bounded: bool = True, **request) -> SearchResult:
    """Search a curated table or any other entry DataFrame."""
    req = SearchRequest(**request)
    chosen: Iterable[str] = req.services
    entries = filter_entries(entries, services=chosen)
    if req.resumes:
        logs.check_cursors(entries, req.service_offsets or {}, req.file_offset)
    return search_entries(windowed(entries, req), req, bounded=bounded)


def search_file(
    spark: SparkSession,
    catalog: Catalog,
    service: str,
    file_name: str,
    *,
    bounded: bool = True,
    **request,
) -> SearchResult:
    """Search one rotated log of one service; entries without a time are cut off first."""
    req = SearchRequest(**{**request, "services": ()})
    log = logs.rotated_service(spark, catalog, service, file_name)
    entries = _scanned(spark, log, req)
    return search_entries(
        entries, req, keep_null_ts=False, bounded=bounded, parsing=req.depth is None, catalog=log
    )
