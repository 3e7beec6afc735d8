"""Exports of a search view: CSV, text and JSON rows.

A view is the whole filtered, capped and ordered result, not one page. The files are written in
parallel; read in name order they are the export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.functions import text as X
from logframe.operators.order import TIE, order_entries, sort_keys

BOM = "\ufeff"


def csv_field(value: Column) -> Column:
    """One CSV field: formula starts get a tab in front; quoted where it needs to be; null is empty."""
    guarded = F.when(F.left(value, F.lit(1)).isin("=", "+", "-", "@"), F.concat(F.lit("\t"), value))
    guarded = guarded.otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n\r]'), quoted).otherwise(F.coalesce(guarded, F.lit("")))


def csv_column() -> Column:
    """An entry as one CSV line."""
    values = [X.ts_text(F.col(c)) if c == "ts" else F.col(c) for _, c in P.CSV_COLUMNS]
    return F.concat_ws(",", *[csv_field(v) for v in values])


def csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per entry, in the order of ``df``, without the header."""
    return df.select(csv_column().alias("value"))


def csv_header() -> str:
    return ",".join(name for name, _ in P.CSV_COLUMNS)


def text_column() -> Column:
    """The raw block of an entry, rebuilt from its fields where the block is blank."""
    raw, stack = F.col("raw_line"), F.col("stack_trace")
    text = F.concat(
        F.coalesce(X.iso_text(F.col("ts"), F.col("ts_nano_rem")), F.lit("null")),
        F.lit(" "),
        F.coalesce("level", F.lit("null")),
        F.lit(" ["),
        F.coalesce("thread", F.lit("")),
        F.lit("] "),
        F.coalesce("logger", F.lit("")),
        F.lit(" - "),
        F.coalesce("message", F.lit("")),
    )
    rebuilt = F.when(X.has_stack_trace(), F.concat(text, F.lit("\n"), stack)).otherwise(text)
    return F.when(raw.isNull() | X.is_blank(raw), rebuilt).otherwise(raw)


def entry_text(df: DataFrame) -> DataFrame:
    """One text per entry, in the order of ``df``."""
    return df.select(text_column().alias("value"))


def json_struct() -> Column:
    """The entry as a struct with its public field names; the byte offset is left out."""
    return F.struct(
        *[(X.ts_text(F.col(c)) if c == "ts" else F.col(c)).alias(name) for name, c in P.JSON_COLUMNS]
    )


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per entry; null fields are left out."""
    return df.select(F.to_json(json_struct()).alias("value"))


def write_csv(df: DataFrame, path: str, order: str = "desc") -> None:
    """Write the view as CSV: a byte-order mark and the header first, then the rows in order.

    The files are ranges of the order, written in parallel; joined in name order they are one export.
    """
    rows = df.select("ts", *TIE, csv_column().alias("value"), F.lit(1).alias("part"))
    head = df.sparkSession.range(1).select(F.lit(BOM + csv_header()).alias("value"), F.lit(0).alias("part"))
    lines = rows.unionByName(head, allowMissingColumns=True)
    lines.orderBy(F.col("part"), *sort_keys(order)).select("value").write.text(path)


def write_txt(df: DataFrame, path: str, order: str = "desc") -> None:
    """Write the view as text: the raw blocks, each followed by one blank line. Files as in ``write_csv``."""
    blocks = df.select("ts", *TIE, text_column().alias("value"))
    blocks.orderBy(*sort_keys(order)).select("value").write.option("lineSep", "\n\n").text(path)


def write_json(df: DataFrame, path: str, order: str = "desc") -> None:
    """Write the view as JSON lines."""
    order_entries(df, order).select(json_struct().alias("entry")).select("entry.*").write.json(path)
