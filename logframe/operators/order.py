"""Ordering, top-k, paging and the scan window.

A top-k over very many tasks must not hand k rows of every task to one task. Each cut here first
counts rows per coarse bucket (a map-side aggregate of a few numbers), finds the bucket in which the
k-th row lies, and keeps only rows up to that bucket. The exact cut then sees about k rows. The bound
only ever removes rows that cannot be among the k, so the answer does not depend on it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.operators.filters import Moment, time_range

TIE = ("ts_nano_rem", "service", "file_path", "file_offset")
_CHUNK_BYTES = 64 * 1024 * 1024
#: Up to so many rows a cap needs no bound: every task's first k rows cost less than a pass over all times.
UNBOUNDED_CAP = 1000
# Services whose window edges (about 200 bytes each) are broadcast.
_MAX_SERVICES = 100_000


def is_asc(order: str | None) -> bool:
    return (order or "").lower() == "asc"


def _directed(column: str, order: str) -> Column:
    return F.col(column).asc_nulls_last() if is_asc(order) else F.col(column).desc_nulls_last()


def sort_keys(order: str = "desc") -> list[Column]:
    """Time in the wanted direction, entries without a time last, then a fixed tie-break."""
    return [_directed("ts", order), _directed("ts_nano_rem", order), *(F.col(c).asc() for c in TIE[1:])]


def order_entries(df: DataFrame, order: str = "desc") -> DataFrame:
    return df.orderBy(*sort_keys(order))


def numbered(df: DataFrame, path: str, order: str = "desc") -> DataFrame:
    """Every row with its ``position`` (from 0) in the order of ``order_entries``, without one task for all.

    Rows are dealt by ranges of the sort keys and written to ``path``, sorted; a row's position is its place in its range
    and the rows of the ranges before it, one number each. Entries of one time fall into several ranges where they are many.
    """
    ranged = df.repartitionByRange(*sort_keys(order)).sortWithinPartitions(*sort_keys(order))
    ranged.withColumn("position", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part, place = F.shiftright("position", 33), F.col("position").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each task
    return rows.join(F.broadcast(bases), part == F.col("_part")).withColumn("position", F.col("_before") + place).drop("_part", "_before")


def _time_bound(df: DataFrame, order: str, k: int) -> tuple[Column, Column]:
    """The time beyond which no row can be among the first k, and the number of timed rows, from one pass."""
    minute = [F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute")]
    counts = (
        df.filter(F.col("ts").isNotNull())
        .groupBy(*minute)
        .agg(F.count(F.lit(1)).alias("n"), (F.max("ts") if is_asc(order) else F.min("ts")).alias("edge"))
    )
    # One row per minute of log time, whatever the number of entries.
    running = Window.orderBy(_directed("day", order), _directed("minute", order))
    cut = counts.withColumn("before", F.sum("n").over(running) - F.col("n"))
    # All minutes count for the total, those before the k-th row for the edge: one subquery, as each would read the rows.
    near = F.when(F.col("before") < k, F.col("edge"))
    edge = F.max(near) if is_asc(order) else F.min(near)
    both = cut.agg(F.struct(edge.alias("edge"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))).scalar()
    return both["edge"], both["total"]


def cap_entries(
    df: DataFrame,
    order: str = "desc",
    k: int | None = None,
    *,
    keep_null_ts: bool = True,
    bounded: bool = True,
) -> DataFrame:
    """The newest or oldest k entries with a time; all entries where k is None.

    Entries without a time never take the place of one with a time. With ``keep_null_ts`` (live search) all of
    them stay beside the k, outside any top-k; otherwise (search in one rotated file) they fill what is left of
    the k. ``bounded`` finds the time of the k-th row first, at the price of reading ``ts`` twice, so that no
    task has k rows of every other to merge; a k of at most ``UNBOUNDED_CAP`` goes without, but in a table by days.
    """
    if k is None:
        return df
    ts = F.col("ts")
    untimed = df.filter(ts.isNull())
    if bounded and (k > UNBOUNDED_CAP or "log_date" in df.columns):
        edge, total = _time_bound(df, order, k)
        inside = ts <= edge if is_asc(order) else ts >= edge
        if "log_date" in df.columns:
            # The day of the bound skips whole partitions but that of entries without a time.
            log_date, day = F.col("log_date"), F.to_date(edge)
            df = df.filter(log_date.isNull() | (log_date <= day if is_asc(order) else log_date >= day))
        df = df.filter(inside | (ts.isNull() & (total < k)))
    if not keep_null_ts:
        return df.orderBy(*sort_keys(order)).limit(k)
    return df.filter(ts.isNotNull()).orderBy(*sort_keys(order)).limit(k).unionByName(untimed)


def page_size(limit: int | None) -> int | None:
    """Rows of a page: no positive limit means all."""
    return limit if limit is not None and limit > 0 else None


def page(df: DataFrame, limit: int | None = P.DEFAULT_PAGE, start: int = 0, order: str = "desc") -> DataFrame:
    """Rows [start, start + limit) of the ordered view; all of them without a limit.

    A start is skipped row by row: deep pages are for ``page_after``.
    """
    ordered = order_entries(df, order)
    ordered = ordered.offset(start) if start else ordered
    size = page_size(limit)
    return ordered if size is None else ordered.limit(size)


def page_after(
    df: DataFrame, after: Row | Mapping | None, limit: int | None = P.DEFAULT_PAGE, order: str = "desc"
) -> DataFrame:
    """The page that follows the row ``after``: a predicate instead of an offset, for deep pages.

    ``after`` has the sort keys of the last entry served: ts, ts_nano_rem, service, file_path, file_offset.
    """
    return page(df if after is None else df.filter(past_row(after, order)), limit, 0, order)


def past_row(after: Row | Mapping, order: str = "desc") -> Column:
    """Whether an entry comes after the row with these sort keys."""
    ts = F.col("ts")
    nano = F.col("ts_nano_rem")
    same_file = (F.col("file_path") == after["file_path"]) & (F.col("file_offset") > after["file_offset"])
    tie = (F.col("service") > after["service"]) | (
        (F.col("service") == after["service"]) & ((F.col("file_path") > after["file_path"]) | same_file)
    )
    finer = nano > after["ts_nano_rem"] if is_asc(order) else nano < after["ts_nano_rem"]
    tie = finer | ((nano == after["ts_nano_rem"]) & tie)
    if after["ts"] is None:
        return ts.isNull() & tie
    at = F.lit(after["ts"]).cast("timestamp_ntz")
    later = ts > at if is_asc(order) else ts < at
    return ts.isNull() | later | ((ts == at) & tie)


def scan_depth(requested: int | None) -> int | None:
    """Entries per service to look at; no positive number means all."""
    return requested if requested is not None and requested > 0 else None


def _log_window(df: DataFrame, n: int, oldest: bool) -> DataFrame:
    """The first or last n entries per service in log order, which is (file path, offset).

    Counts per 64 MiB of log tell in which of these chunks the n-th entry of a service lies. Entries of
    the chunks inside pass by a filter; only those of that edge chunk are numbered, so a window costs
    the shuffle of one chunk per service.
    """
    place = F.struct(F.col("file_path"), F.floor(F.col("file_offset") / _CHUNK_BYTES).alias("chunk"))
    counts = df.groupBy("service", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    toward = F.col("place").asc() if oldest else F.col("place").desc()
    upto = F.sum("n").over(Window.partitionBy("service").orderBy(toward))
    needed = counts.withColumn("before", upto - F.col("n")).filter(F.col("before") < n)
    outermost = F.max if oldest else F.min
    edge = outermost(F.struct("place", (F.lit(n) - F.col("before")).alias("room")))
    bounds = needed.groupBy(F.col("service").alias("_service")).agg(edge.alias("_edge"))
    # One row per service: broadcast up to a number that is checked while it runs.
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    too_many = F.raise_error(F.lit(f"More than {_MAX_SERVICES} services: search them in groups"))
    checked = bounds.withColumn("_total", total)
    checked = checked.withColumn("_service", F.when(F.col("_total") > _MAX_SERVICES, too_many).otherwise(F.col("_service")))
    near = df.withColumn("_place", place).join(
        F.broadcast(checked.drop("_total")), F.col("service").eqNullSafe(F.col("_service"))
    )
    at, edge = F.col("_place"), F.col("_edge.place")
    inner = near.filter((at < edge) if oldest else (at > edge))
    offset = F.col("file_offset")
    in_chunk = Window.partitionBy("service", "_place").orderBy(offset.asc() if oldest else offset.desc())
    ranked = near.filter(at == edge).withColumn("_rank", F.row_number().over(in_chunk))
    ranked = ranked.filter(F.col("_rank") <= F.col("_edge.room"))
    return inner.select(*df.columns).unionByName(ranked.select(*df.columns))


def bounded_by_time(order: str, from_ts: Moment | None, to_ts: Moment | None) -> bool:
    """Whether the window of ``scan_window`` depends on the time of an entry, not only on its place."""
    return (from_ts if is_asc(order) else to_ts) is not None


def scan_window(
    df: DataFrame,
    n: int,
    order: str = "desc",
    *,
    from_ts: Moment | None = None,
    to_ts: Moment | None = None,
    filtered: bool = False,
    streamed: bool = False,
) -> DataFrame:
    """The n entries per service that a search looks at, before any filter.

    Newest first: the last n, at or before ``to_ts`` where given. Oldest first with a time range: the
    first n from ``from_ts``. Oldest first with any other filter or a query (``filtered``): the last
    n; without: the first n. A ``streamed`` log (gzip) is read from its start in any case.
    """
    if streamed:
        return _log_window(df, n, oldest=True)
    if not is_asc(order):
        return _log_window(time_range(df, to_ts=to_ts), n, oldest=False)
    if from_ts is not None or to_ts is not None:
        return _log_window(time_range(df, from_ts=from_ts), n, oldest=True)
    return _log_window(df, n, oldest=not filtered)
