"""The curated table: parsed entries as Parquet, partitioned by service and day.

Parsing raw text pays a scan, a shuffle and the regexes for every search. Written once as a table,
a search reads only the partitions, row groups and columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logframe.schema import ENTRY_SCHEMA

PARTITIONS = ("service", "log_date")
TABLE_SCHEMA = T.StructType(ENTRY_SCHEMA.fields + [T.StructField("log_date", T.DateType())])


def write_entries(df: DataFrame, path: str, mode: str = "errorifexists", *, rebalance: bool = True) -> None:
    """Write entries below ``path``, sorted by time within each file.

    A second run fails instead of doubling the entries; ``mode="append"`` adds logs that are not in the table.

    Adaptive execution brings a service's day together, splits a hot one over as many tasks as its
    size asks for and joins small ones, so files are neither tiny nor huge. Without ``rebalance`` the
    rows stay in the tasks that assembled them: one shuffle less, more and smaller files.
    """
    dated = df.withColumn("log_date", F.to_date("ts"))
    placed = dated.hint("rebalance", *PARTITIONS) if rebalance else dated
    placed.sortWithinPartitions(*PARTITIONS, "ts").write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The curated table, with the partition column ``log_date`` for time ranges."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)
