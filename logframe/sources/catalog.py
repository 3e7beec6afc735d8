"""The configured services and the files behind them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.schema import CATALOG_SCHEMA

SAFE_NAME = re.compile(r"[a-zA-Z0-9._-]+")
#: Tasks of one listing.
LISTING_TASKS = 200
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@dataclass(frozen=True)
class Service:
    """A service: its name, its active log (a file, or a directory of part files) and its colour."""

    name: str
    log_file: str
    color: str | None = None

    @property
    def directory(self) -> str:
        return self.log_file.rstrip("/").rpartition("/")[0]

    @property
    def active_name(self) -> str:
        return self.log_file.rstrip("/").rpartition("/")[2]

    @property
    def base_name(self) -> str:
        return self.active_name.removesuffix(".log")

    def is_rotated(self, name: str) -> bool:
        """True for a rotated log of this service: its base name, then ``.`` or ``-``."""
        rest = name.removeprefix(self.base_name)
        return name != self.active_name and name.startswith(self.base_name) and rest[:1] in (".", "-")


Catalog = tuple[Service, ...]


def service_catalog(rows: Iterable[Service | Mapping[str, str] | tuple]) -> Catalog:
    """The catalog from services, mappings (name, log_file, color) or tuples."""

    def one(row) -> Service:
        if isinstance(row, Service):
            return row
        return Service(**row) if isinstance(row, Mapping) else Service(*row)

    return tuple(one(row) for row in rows)


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """The catalog from JSON lines with ``name``, ``log_file`` and ``color``."""
    rows = spark.read.schema(CATALOG_SCHEMA).json(path).collect()
    return service_catalog(row.asDict() for row in rows)


def catalog_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(s.name, s.log_file, s.color) for s in catalog], CATALOG_SCHEMA)


def resolve_services(catalog: Catalog, names: Iterable[str] | None) -> Catalog:
    """The configured services among ``names``; all of them when none are named."""
    wanted = set(names or ())
    return tuple(s for s in catalog if not wanted or s.name in wanted)


def find_service(catalog: Catalog, name: str) -> Service | None:
    return next((s for s in catalog if s.name == name), None)


@contextmanager
def _few_listing_tasks() -> Iterator[None]:
    """Listings in at most so many tasks; Spark's default is a task for each folder, which costs more than the listing."""
    conf = SparkSession.active().conf
    before = conf.get(_LISTING)
    conf.set(_LISTING, str(min(int(before), LISTING_TASKS)))
    try:
        yield
    finally:
        conf.set(_LISTING, before)


def load_existing(reader: DataFrameReader, paths: Iterable[str]) -> DataFrame | None:
    """``reader.load`` of the paths that exist, or None where none does."""
    paths = list(dict.fromkeys(paths))
    try:
        with _few_listing_tasks():
            return reader.load(paths) if paths else None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    # Something is absent: look at each path.
    found = [p for p in paths if len(paths) > 1 and load_existing(reader, [p]) is not None]
    with _few_listing_tasks():
        return reader.load(found) if found else None


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _location(path: str) -> str:
    """A path to compare by: without a ``file:`` scheme and without a closing slash."""
    path = re.sub(r"^file:(//[^/]*)?", "", path)
    return path.rstrip("/")


def list_log_files(spark: SparkSession, services: Catalog) -> DataFrame:
    """Service, URI, length, modification time and path of every file of the services' logs.

    One listing for all services; no content is read. A file belongs to the services whose log is the
    file or a directory above it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = load_existing(reader, (s.log_file for s in services))
    if files is None:
        schema = "service string, file_path string, length long, modificationTime timestamp, path string"
        return spark.createDataFrame([], schema)
    named = files.select(F.input_file_name().alias("file_path"), "length", "modificationTime", "path")
    # A plus sign stands for itself in a path.
    full = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))
    bare = F.regexp_replace(full, _SCHEME, "")
    steps = F.split(bare, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
    )
    root = F.regexp_extract(full, _SCHEME, 0)
    is_local = F.startswith(root, F.lit("file:"))
    keys = F.when(is_local, above).otherwise(
        F.array_union(above, F.transform(above, lambda path: F.concat(root, path)))
    )
    pairs = [F.struct(F.lit(s.name).alias("service"), F.lit(_location(s.log_file)).alias("location")) for s in services]
    roots = spark.range(1).select(F.inline(F.array(*pairs)))
    return (
        named.withColumn("location", F.explode(keys))
        .join(roots, "location")
        .select("service", "file_path", "length", "modificationTime", "path")
    )


def service_status(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row per service: colour, log file, whether it exists, whole KiB and modification time."""
    sizes = (
        list_log_files(spark, catalog)
        .groupBy(F.col("service").alias("name"))
        .agg(F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("modified"))
    )
    modified = F.date_format("modified", "EEE MMM dd HH:mm:ss zzz yyyy")
    return (
        catalog_frame(spark, catalog)
        .join(sizes, "name", "left")
        .select(
            "name",
            F.coalesce("color", F.lit(P.DEFAULT_COLOR)).alias("color"),
            "log_file",
            F.col("n_bytes").isNotNull().alias("exists"),
            F.floor(F.coalesce("n_bytes", F.lit(0)) / 1024).cast("long").alias("size_kb"),
            F.coalesce(modified, F.lit("N/A")).alias("last_modified"),
        )
    )


def _log_name(path: Column, directory: str) -> Column:
    """The log a file belongs to: itself, or the directory whose part file it is; else null."""
    root = re.sub(_SCHEME, "", directory).rstrip("/") + "/"
    inside = F.split(F.substring_index(path, root, -1), "/")
    is_file = F.size(inside) == 1
    is_part = (F.size(inside) == 2) & F.startswith(F.element_at(inside, -1), F.lit("part-"))
    return F.when(is_file | is_part, F.get(inside, F.lit(0)))


def list_rotated(spark: SparkSession, catalog: Catalog, service: str) -> DataFrame:
    """Name, KiB (rounded up) and modification time of a service's rotated logs, newest first."""
    found = find_service(catalog, service)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = load_existing(reader, [found.directory] if found and found.directory else [])
    if files is None:
        return spark.createDataFrame([], "name string, size_kb long, last_modified string")
    name, base = F.col("name"), found.base_name
    rotated = (
        F.startswith(name, F.lit(base))
        & F.substring(name, len(base) + 1, 1).isin(".", "-")
        & (name != found.active_name)
    )
    logs = (
        files.withColumn("name", _log_name(F.col("path"), found.directory))
        .filter(rotated)
        .groupBy("name")
        .agg(F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("modified"))
    )
    instant = F.to_utc_timestamp("modified", F.current_timezone())
    text = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return logs.orderBy(F.desc("modified"), "name").select(
        "name",
        F.ceil(F.col("n_bytes") / 1024).cast("long").alias("size_kb"),
        F.concat(F.regexp_replace(text, r"\.000$", ""), F.lit("Z")).alias("last_modified"),
    )
