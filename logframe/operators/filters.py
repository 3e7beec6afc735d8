"""Structural filters: predicates on the fields of an entry, joined by AND."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions import patterns as P

PRESETS = {
    "5m": timedelta(minutes=5),
    "15m": timedelta(minutes=15),
    "30m": timedelta(minutes=30),
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
}

Moment = datetime | str


def is_set(text: str | None) -> bool:
    return text is not None and bool(text.strip())


def merge_values(values: Iterable[str] | None = None, single: str | None = None) -> list[str]:
    """The wanted ids: list items as they are, the single value split on commas and trimmed."""
    listed = [v for v in values or () if is_set(v)]
    return listed + [p.strip() for p in (single or "").split(",") if is_set(p)]


def moment(value: Moment | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value.replace(tzinfo=None) if isinstance(value, datetime) else value).cast("timestamp_ntz")


def _day(value: Moment) -> date:
    return (datetime.fromisoformat(value) if isinstance(value, str) else value).date()


def level_equals(level: str) -> Column:
    return F.lower("level") == F.lower(F.lit(level))


def any_contains(column: str, values: Iterable[str]) -> Column:
    """Case-sensitive substring match on any of the values; a null field never matches."""
    return F.coalesce(reduce(or_, (F.contains(F.col(column), F.lit(v)) for v in values)), F.lit(False))


def contains(column: str, value: str) -> Column:
    return any_contains(column, [value])


def contains_ignore_case(column: str, value: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(value))), F.lit(False))


def block_contains(value: str, *, ignore_case: bool = False, level: bool = False) -> Column:
    """True for every raw block of which a parsed field can contain ``value``.

    A field is a piece of its block, unless colour codes were cut out of the middle of it. Blocks with
    such codes pass, as does any block for a value whose lower case depends on its neighbours and for
    the level of unparsed lines, which is not in the text.
    """
    raw = F.col("raw_line")
    if not value.isascii() or (level and value.strip().lower() == P.UNKNOWN_LEVEL.lower()):
        return F.lit(True)
    found = (
        F.contains(F.lower(raw), F.lower(F.lit(value))) if ignore_case else F.contains(raw, F.lit(value))
    )
    return found | F.contains(raw, F.lit("\x1b"))


def filters_on_block(
    *,
    level: str | None = None,
    trace_ids: Iterable[str] | None = None,
    trace_id: str | None = None,
    span_ids: Iterable[str] | None = None,
    span_id: str | None = None,
    user_id: str | None = None,
    site_id: str | None = None,
    tenant_id: str | None = None,
    logger: str | None = None,
    message: str | None = None,
    **_unused,
) -> Column:
    """A predicate on the raw block that every entry passing ``filter_entries`` passes."""
    tests = [
        reduce(or_, (block_contains(v) for v in wanted))
        for wanted in (merge_values(trace_ids, trace_id), merge_values(span_ids, span_id))
        if wanted
    ]
    tests += [block_contains(v) for v in (user_id, site_id, tenant_id) if is_set(v)]
    tests += [block_contains(v, ignore_case=True) for v in (logger, message) if is_set(v)]
    if is_set(level):
        tests.append(block_contains(level, ignore_case=True, level=True))
    return reduce(and_, tests) if tests else F.lit(True)


def time_range(df: DataFrame, from_ts: Moment | None = None, to_ts: Moment | None = None) -> DataFrame:
    """Keep entries in [from, to] and those without a time.

    On a table with ``log_date`` partitions the range also names the dates, so whole partitions are
    skipped; the partition of entries without a time stays.
    """
    ts = F.col("ts")
    dated = "log_date" in df.columns
    for bound, after in ((from_ts, True), (to_ts, False)):
        if bound is None:
            continue
        limit = moment(bound)
        df = df.filter(ts.isNull() | ((ts >= limit) if after else (ts <= limit)))
        if dated:
            log_date = F.col("log_date")
            day = F.lit(_day(bound)) if not isinstance(bound, Column) else F.to_date(bound)
            df = df.filter(log_date.isNull() | ((log_date >= day) if after else (log_date <= day)))
    return df


def last(df: DataFrame, preset: str, now: Moment | None = None) -> DataFrame:
    """Keep the last 5m, 15m, 30m, 1h, 6h or 24h up to ``now``, by default the time of the call."""
    end = datetime.now() if now is None else now
    end = datetime.fromisoformat(end) if isinstance(end, str) else end
    return time_range(df, from_ts=end - PRESETS[preset])


def filter_entries(
    df: DataFrame,
    *,
    services: Iterable[str] | None = None,
    level: str | None = None,
    trace_ids: Iterable[str] | None = None,
    trace_id: str | None = None,
    span_ids: Iterable[str] | None = None,
    span_id: str | None = None,
    user_id: str | None = None,
    site_id: str | None = None,
    tenant_id: str | None = None,
    logger: str | None = None,
    message: str | None = None,
    from_ts: Moment | None = None,
    to_ts: Moment | None = None,
) -> DataFrame:
    """Entries that pass every filter that is set; blank values are not set."""
    tests: list[Column] = []
    if services:
        tests.append(F.col("service").isin(*services))
    if is_set(level):
        tests.append(level_equals(level))
    for column, wanted in (
        ("trace_id", merge_values(trace_ids, trace_id)),
        ("span_id", merge_values(span_ids, span_id)),
    ):
        if wanted:
            tests.append(any_contains(column, wanted))
    for column, value in (("user_id", user_id), ("site_id", site_id), ("tenant_id", tenant_id)):
        if is_set(value):
            tests.append(contains(column, value))
    for column, value in (("logger", logger), ("message", message)):
        if is_set(value):
            tests.append(contains_ignore_case(column, value))
    df = df.filter(reduce(and_, tests)) if tests else df
    return time_range(df, from_ts, to_ts)
