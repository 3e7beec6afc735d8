"""Scans of log files: active, rotated, plain and gzip."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from logframe.operators.parse import parse_entries
from logframe.operators.scan import BlockScan
from logframe.schema import LINE_SCHEMA
from logframe.sources.catalog import (
    SAFE_NAME,
    Catalog,
    Service,
    find_service,
    list_log_files,
    load_existing,
    resolve_services,
)


def _text_reader(spark: SparkSession, skip_damaged: bool = False) -> DataFrameReader:
    reader = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    skip = str(skip_damaged).lower()
    return reader.option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", "false")


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files whose gzip stream is broken or ends early; a file may hold several members."""
    for batch in batches:
        bad = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rest, whole = memoryview(content.as_buffer()), True
            try:
                while len(rest) and whole:
                    member, at = zlib.decompressobj(zlib.MAX_WBITS | 16), 0
                    while at < len(rest) and not member.eof:
                        member.decompress(rest[at : at + (1 << 20)])
                        at += 1 << 20
                    whole = member.eof
                    rest = memoryview(member.unused_data + bytes(rest[at:])) if member.unused_data else rest[at:]
            except zlib.error:
                whole = False
            bad += [] if whole else [path]
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file_path"])


def damaged_files(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """The gzip files at ``paths`` that cannot be read to their end: what ``skip_damaged`` loses rows of.

    A file is read whole by one task, so it must be below 2 GB; larger logs are better written in parts.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz")
    found = load_existing(reader, [paths] if isinstance(paths, str) else paths)
    if found is None:
        return spark.createDataFrame([], "file_path string")
    return found.select("path", "content").mapInArrow(_damage, "file_path string")


def read_log_lines(
    spark: SparkSession, paths: str | Iterable[str], *, skip_damaged: bool = False
) -> DataFrame:
    """The lines of the logs at ``paths``, carriage returns included, with their place in the file.

    A path is a file or a directory of part files; ``.gz`` is read as gzip. An absent path and an
    empty file give no rows. All logs are one scan. A file that cannot be read to its end fails the job;
    with ``skip_damaged`` it gives the lines before the damage, and ``damaged_files`` names it.
    """
    found = load_existing(_text_reader(spark, skip_damaged), [paths] if isinstance(paths, str) else paths)
    if found is None:
        return spark.createDataFrame([], LINE_SCHEMA)
    # File, split and row id are taken in the scan itself, where rows still come in file order.
    return found.select(
        F.input_file_name().alias("file_path"),
        F.input_file_block_start().alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )


def read_service_lines(
    spark: SparkSession,
    catalog: Catalog,
    names: Iterable[str] | None = None,
    *,
    skip_damaged: bool = False,
) -> DataFrame:
    """The lines of the active logs of the named services, all services when none are named."""
    paths = [s.log_file for s in resolve_services(catalog, names)]
    return read_log_lines(spark, paths, skip_damaged=skip_damaged)


def read_blocks(
    spark: SparkSession,
    catalog: Catalog,
    names: Iterable[str] | None = None,
    *,
    keep_blank: bool = False,
    keep_orphan: bool = True,
    skip_damaged: bool = False,
) -> DataFrame:
    """The assembled, unparsed blocks of the active logs of the named services."""
    kept = {"keep_blank": keep_blank, "keep_orphan": keep_orphan, "skip_damaged": skip_damaged}
    return scan_blocks(spark, resolve_services(catalog, names), **kept).blocks()


def scan_blocks(
    spark: SparkSession,
    services: Catalog,
    *,
    keep_blank: bool = False,
    keep_orphan: bool = True,
    skip_damaged: bool = False,
) -> BlockScan:
    """The scan of the active logs of the services, of which all blocks or a window of them can be read."""
    lines = read_service_lines(spark, services, skip_damaged=skip_damaged)
    return BlockScan(lines, list_log_files(spark, services), keep_blank=keep_blank, keep_orphan=keep_orphan)


def read_services(
    spark: SparkSession,
    catalog: Catalog,
    names: Iterable[str] | None = None,
    *,
    keep_blank: bool = False,
    keep_orphan: bool = True,
    skip_damaged: bool = False,
) -> DataFrame:
    """The parsed entries of the active logs of the named services."""
    kept = {"keep_blank": keep_blank, "keep_orphan": keep_orphan, "skip_damaged": skip_damaged}
    return parse_entries(read_blocks(spark, catalog, names, **kept))


def rotated_path(catalog: Catalog, service: str, file_name: str) -> str:
    """The path of one rotated log; ValueError for a name that is not one."""
    if not SAFE_NAME.fullmatch(service):
        raise ValueError(f"Not a service name: {service!r}")
    found = find_service(catalog, service)
    if found is None:
        raise ValueError(f"The catalog has no service {service!r}")
    if not SAFE_NAME.fullmatch(file_name) or ".." in file_name:
        raise ValueError(f"Not a plain log name: {file_name!r}")
    if file_name == found.active_name:
        raise ValueError(f"{file_name!r} is still being written; read it with read_services or search")
    if not found.is_rotated(file_name):
        raise ValueError(f"{file_name!r} is no rotated log of {service!r}")
    return f"{found.directory}/{file_name}"


def rotated_service(
    spark: SparkSession, catalog: Catalog, service: str, file_name: str
) -> Catalog:
    """One rotated log as a catalog of its own; ValueError where there is no such log."""
    path = rotated_path(catalog, service, file_name)
    if load_existing(_text_reader(spark), [path]) is None:
        raise ValueError(f"{path} does not exist")
    return (Service(service, path),)


def read_rotated(
    spark: SparkSession,
    catalog: Catalog,
    service: str,
    file_name: str,
    *,
    keep_blank: bool = False,
    keep_orphan: bool = True,
    skip_damaged: bool = False,
) -> DataFrame:
    """The parsed entries of exactly one rotated log of one service."""
    one = rotated_service(spark, catalog, service, file_name)
    kept = {"keep_blank": keep_blank, "keep_orphan": keep_orphan, "skip_damaged": skip_damaged}
    return read_services(spark, one, **kept)


def resume(
    df: DataFrame,
    offsets: Mapping[str, int],
    order: str = "desc",
    *,
    default: int | None = None,
    key: str = "service",
) -> DataFrame:
    """The entries past a byte cursor per ``key``: before it newest first, after it oldest first.

    A cursor of the key beats ``default``; without either, all entries stay. Bytes tell what was served only
    within one file: use ``key="file_path"`` where a service has several files, and ``page_after`` to walk the
    pages of a search, whatever its files.
    """
    cursor = F.lit(default).cast("long")
    if offsets:
        pairs = [F.lit(v) for item in offsets.items() for v in item]
        cursor = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)).cast("long"), cursor)
    at = F.col("file_offset")
    past = at > cursor if order.lower() == "asc" else at < cursor
    return df.filter(cursor.isNull() | past)


def check_cursors(files: DataFrame, offsets: Mapping[str, int], default: int | None) -> None:
    """ValueError where a byte cursor of a service would cover several files (service, file_path), as listed or read."""
    counted = files if default is not None else files.filter(F.col("service").isin(list(offsets)))
    several = counted.groupBy("service").agg(F.min("file_path").alias("a"), F.max("file_path").alias("b")).filter("a <> b")
    found = several.select("service").first()
    if found is not None:
        raise ValueError(f"{found[0]!r} has several files: resume with after=, the last entry served")


def damaged_logs(spark: SparkSession, services: Catalog) -> DataFrame:
    """Service and file of the services' gzip logs that cannot be read to their end (see ``damaged_files``)."""
    listed = list_log_files(spark, services)
    found = damaged_files(spark, [s.log_file for s in services]).select(F.regexp_replace("file_path", "^file:/+", "/").alias("bad"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return listed.join(found, path == F.col("bad"), "left_semi").select("service", "file_path")
