"""A side table of raw logs: for every few thousand entries of a file their numbers and times.

A search with a time range reads only the files, and of those only the splits, that hold entries of the range or entries
without a time. The table only says where to look: rows are the same with and without it. A file whose length or
modification time is not the one of the table, or that it does not have, is read in full.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logframe.operators.assemble import file_id
from logframe.operators.filters import Moment, moment
from logframe.operators.parse import parse_entries
from logframe.operators.scan import LAST_ENTRY, BlockScan
from logframe.sources.catalog import Catalog, list_log_files
from logframe.sources.logs import read_log_lines

#: Entries that one row of the table tells of.
PIECE = 4096
INDEX_SCHEMA = (
    "file_path string, length long, modified timestamp, piece long, low long, high long, "
    "first_ts timestamp_ntz, last_ts timestamp_ntz, entries long, untimed long"
)


def _listed(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return list_log_files(spark, catalog).withColumnRenamed("modificationTime", "modified")


def _same_file(index: DataFrame) -> list[str]:
    return ["file_path", "length", "modified"]


def escaped(path: str) -> str:
    """A path of which no character is taken for a pattern."""
    return "".join(f"\\{c}" if c in "\\[]{}*?" else c for c in path)


def log_index(spark: SparkSession, catalog: Catalog, known: DataFrame | None = None) -> DataFrame:
    """The side table of the services' logs. Rows of ``known`` (an older table) are taken over for files that did not change."""
    listed = _listed(spark, catalog).drop("service").distinct()
    unknown = listed if known is None else listed.join(known.select(*_same_file(known)).distinct(), _same_file(known), "left_anti")
    if known is None:
        paths = [s.log_file for s in catalog]
    else:
        paths = [escaped(r.path) for r in unknown.select("path").collect()]  # Spark's own listing of them is on the driver as well
    scan = BlockScan(read_log_lines(spark, paths), unknown.withColumn("service", F.lit(None).cast("string")))
    # The parser carries the line number along: here it is the number of the entry.
    entries = parse_entries(scan.blocks().withColumn("line_number", F.col("entry_seq"))).select("file_path", F.col("line_number").alias("seq"), "ts")
    pieces = entries.groupBy("file_path", F.floor(F.col("seq") / PIECE).alias("piece")).agg(
        F.min("seq").alias("low"),
        F.max("seq").alias("high"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("entries"),
        F.count_if(F.col("ts").isNull()).alias("untimed"),
    )
    columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    # A file without entries has a row as well, else it would be read in full each time.
    none = {"piece": 0, "low": 0, "high": -1, "entries": 0, "untimed": 0}
    found = unknown.join(pieces, "file_path", "left").fillna(none).select(*columns)
    if known is None:
        return found
    return found.unionByName(known.join(listed.select(*_same_file(known)), _same_file(known), "left_semi").select(*columns))


def write_log_index(spark: SparkSession, catalog: Catalog, path: str, known: DataFrame | None = None) -> None:
    log_index(spark, catalog, known).write.parquet(path)


def read_log_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def _in_range(from_ts: Moment | None, to_ts: Moment | None) -> Column:
    """Whether a row of the table can hold entries of the range; entries without a time are in every range."""
    inside = F.lit(True)
    if from_ts is not None:
        inside = inside & (F.col("last_ts") >= moment(from_ts))
    if to_ts is not None:
        inside = inside & (F.col("first_ts") <= moment(to_ts))
    return (F.col("untimed") > 0) | F.coalesce(inside, F.lit(False))


def wanted_entries(spark: SparkSession, catalog: Catalog, index: DataFrame, from_ts: Moment | None, to_ts: Moment | None) -> DataFrame:
    """Where a time range is: service, file_path, path, file_id and ranges (low, high) of entry numbers."""
    listed = _listed(spark, catalog)
    told = listed.join(index, _same_file(index), "left")
    whole = F.col("piece").isNull()
    near = told.filter(whole | _in_range(from_ts, to_ts))
    # Neighbouring pieces are one range.
    in_file = Window.partitionBy("service", "file_path").orderBy("piece")
    apart = F.coalesce(F.col("piece") - F.lag("piece").over(in_file) > 1, F.lit(True)).cast("int")
    runs = near.withColumn("run", F.sum(apart).over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("service", "file_path", "path", "run").agg(
        F.coalesce(F.min("low"), F.lit(0)).alias("low"), F.coalesce(F.max("high"), F.lit(LAST_ENTRY)).alias("high")
    ).withColumn("file_id", file_id()).drop("run")


def blocks_in_range(
    spark: SparkSession, catalog: Catalog, index: DataFrame, from_ts: Moment | None, to_ts: Moment | None, **kept: bool
) -> DataFrame:
    """The blocks of the services' logs that can lie in a time range, and some more; the time filter comes after them."""
    wanted = wanted_entries(spark, catalog, index, from_ts, to_ts)
    columns = {"service": pa.string(), "file_path": pa.string(), "file_id": pa.int64(), "low": pa.int64(), "high": pa.int64()}
    rows = wanted.select(*columns, "path").collect()  # some for each file to be read
    paths = sorted({escaped(r.path) for r in rows})
    held = spark.createDataFrame(pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in columns.items()}))
    lines = read_log_lines(spark, paths, skip_damaged=kept.pop("skip_damaged", False))
    scan = BlockScan(lines, held.select("service", "file_path"), **kept)
    whole = all(r.low <= 0 and r.high == LAST_ENTRY for r in rows)
    return scan.blocks(None if whole else held.drop("file_path"))
