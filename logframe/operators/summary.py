"""Counts and resume positions of a search."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logframe.operators.order import is_asc


def next_offsets(served: DataFrame, order: str = "desc", key: str = "service") -> DataFrame:
    """One row per key over the rows served so far: the byte offset to resume from, within one file."""
    edge = F.max("file_offset") if is_asc(order) else F.min("file_offset")
    placed = served.filter(F.col(key).isNotNull() & F.col("file_offset").isNotNull())
    return placed.groupBy(key).agg(edge.alias("next_offset"))


def offsets_map(served: DataFrame, order: str = "desc", key: str = "service") -> DataFrame:
    """``next_offsets`` as one MAP<STRING, BIGINT> value, one entry per service."""
    offsets = next_offsets(served, order, key)
    pairs = F.sort_array(F.collect_list(F.struct(key, "next_offset")))
    return offsets.agg(F.map_from_entries(pairs).alias("next_offsets"))


def search_summary(
    structural: DataFrame,
    page: DataFrame,
    *,
    matched: Column,
    cap: int | None = None,
    keep_null_ts: bool = True,
    limit: int | None,
    start: int = 0,
    order: str = "desc",
    served: DataFrame | None = None,
) -> DataFrame:
    """One row: rows past the structural filters, rows of the view, limit, order, offsets, has_more.

    All counts are one aggregate over the structurally filtered entries; ``matched`` is the search text.
    The offsets come from the rows served.
    """
    timed = F.count_if(matched & F.col("ts").isNotNull())
    untimed = F.count_if(matched & F.col("ts").isNull())
    if cap is None:
        total = timed + untimed
    elif keep_null_ts:
        total = F.least(timed, F.lit(cap)) + untimed
    else:
        total = F.least(timed + untimed, F.lit(cap))
    counts = structural.agg(total.alias("total_matched"), F.count(F.lit(1)).alias("filtered_by_structured"))
    seen = offsets_map(page if served is None else served, order)
    end = F.lit(start + limit) if limit is not None else F.col("total_matched")
    return counts.crossJoin(seen).select(
        "total_matched",
        "filtered_by_structured",
        F.lit(limit).cast("int").alias("page_limit"),
        F.lit("asc" if is_asc(order) else "desc").alias("sort_order"),
        "next_offsets",
        (end < F.col("total_matched")).alias("has_more"),
    )


def summary_row(
    spark: SparkSession, total: int, structural: int, limit: int | None, start: int, order: str, offsets: Mapping[str, int]
) -> DataFrame:
    """The row of ``search_summary`` from counts that are known."""
    names = F.array(*map(F.lit, offsets)).cast("array<string>")
    places = F.array(*map(F.lit, offsets.values())).cast("array<bigint>")
    end = total if limit is None else start + limit
    return spark.range(1).select(
        F.lit(total).cast("long").alias("total_matched"),
        F.lit(structural).cast("long").alias("filtered_by_structured"),
        F.lit(limit).cast("int").alias("page_limit"),
        F.lit("asc" if is_asc(order) else "desc").alias("sort_order"),
        F.map_from_arrays(names, places).alias("next_offsets"),
        F.lit(end < total).alias("has_more"),
    )
