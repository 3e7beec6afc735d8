"""Lines to entry blocks: a line that does not open an entry belongs to the entry above it.

The text is shuffled once, by (file, input split): a key that no single file can make hot. Everything
local to a split happens on that distribution, the running entry number, the byte position and the
joining of lines. What a split cannot know by itself (how many entries, bytes and lines come before
it, and which lines at the head of later splits continue its last entry) is one row per split. Those
rows are computed from the same shuffle, which Spark reuses as every reader of it needs the same four
columns, and are hash-joined on the same key, so that the text does not move again. Nothing is
broadcast. A file travels as a 64-bit id; its path comes back with the row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logframe.functions import text as X

_SPLIT = ("file_id", "split_start")


def file_id() -> Column:
    return F.xxhash64("file_path")


def file_ids(files: DataFrame) -> DataFrame:
    """One row per file and service: id, service and path. Two paths under one id fail the job."""
    clash = F.raise_error(F.concat(F.lit("Two log files share an id: "), F.array_join("paths", ", ")))
    return (
        files.groupBy(file_id().alias("file_id"))
        .agg(F.collect_set("file_path").alias("paths"), F.collect_set("service").alias("services"))
        .select(
            "file_id",
            F.explode_outer("services").alias("service"),
            F.when(F.size("paths") > 1, clash).otherwise(F.get("paths", F.lit(0))).alias("file_path"),
        )
    )


def _split_index(rows: DataFrame, files: DataFrame, kept: Column) -> DataFrame:
    """One row per split that opens an entry or its file: what precedes it and continues its tail."""
    new = X.is_new_entry(F.col("line"))
    totals = rows.groupBy(*_SPLIT).agg(
        F.count_if(new).alias("n_new"),
        F.sum(X.line_bytes(F.col("value"))).alias("n_bytes"),
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.min(F.when(new, F.col("row_id"))), F.lit(2**63 - 1)).alias("first_new"),
    )
    head = F.when((F.col("row_id") < F.col("first_new")) & kept, F.struct("row_id", "line"))
    per_split = (
        rows.join(totals.hint("shuffle_hash"), list(_SPLIT))
        .groupBy(*_SPLIT)
        .agg(
            *[F.first(c).alias(c) for c in ("n_new", "n_bytes", "n_lines")],
            F.transform(F.sort_array(F.collect_list(head)), lambda r: r["line"]).alias("head"),
        )
    )
    in_file = Window.partitionBy("file_id").orderBy("split_start")
    upto = in_file.rowsBetween(Window.unboundedPreceding, 0)

    def sum_before(column: str) -> Column:
        return F.sum(column).over(upto) - F.col(column)

    based = per_split.select(
        *_SPLIT,
        "n_new",
        "head",
        sum_before("n_new").alias("base_seq"),
        sum_before("n_bytes").alias("base_bytes"),
        sum_before("n_lines").alias("base_lines"),
        (F.row_number().over(in_file) == 1).alias("opens_file"),
    )
    # Runs are numbered by the splits that open an entry (or the file). The head lines of a split
    # belong to the run before it; a split that opens nothing is all head.
    opens = F.col("opens_file") | (F.col("n_new") > 0)
    numbered = based.withColumn("run", F.sum(opens.cast("long")).over(upto))
    owner = F.struct("split_start", "n_new", "base_seq", "base_bytes", "base_lines", "opens_file")
    head = F.struct("split_start", "head")

    def role(run: Column, as_owner: Column, as_head: Column) -> Column:
        return F.struct(run.alias("run"), as_owner.alias("owner"), as_head.alias("head"))

    roles = F.array_compact(
        F.array(
            F.when(opens, role(F.col("run"), owner, F.when(F.lit(False), head))),
            F.when(
                ~F.col("opens_file"),
                role(F.col("run") - opens.cast("long"), F.when(F.lit(False), owner), head),
            ),
        )
    )
    tails = (
        numbered.select("file_id", F.inline(roles))
        .groupBy("file_id", "run")
        .agg(
            F.get(F.collect_list("owner"), F.lit(0)).alias("owner"),
            F.flatten(F.transform(F.sort_array(F.collect_list("head")), lambda h: h["head"])).alias("carry"),
        )
    )
    # A file that came after the listing has no name here: its lines fail the job instead of vanishing.
    late = F.raise_error(F.lit("A log file was written between its listing and the scan; list and read again"))
    named = tails.select("file_id", "owner.*", "carry").join(file_ids(files), "file_id", "left")
    return named.withColumn("file_path", F.when(F.col("file_path").isNull(), late).otherwise(F.col("file_path")))


def assemble_entries(
    lines: DataFrame,
    files: DataFrame | None = None,
    *,
    keep_blank: bool = False,
    keep_orphan: bool = True,
) -> DataFrame:
    """Entry blocks with their number, line and first byte in the file.

    ``files`` lists the service and path of each file, a file of several services several times;
    without it the paths are read off the lines and the service is null.
    ``keep_blank`` keeps blank continuation lines; ``keep_orphan`` keeps the lines before a file's
    first entry as one entry numbered 0.
    """
    if files is None:
        files = lines.select(F.lit(None).cast("string").alias("service"), "file_path").distinct()
    shuffled = lines.select(file_id().alias("file_id"), "split_start", "row_id", "value").repartition(*_SPLIT)
    rows = shuffled.withColumn("line", X.strip_cr(F.col("value")))
    new, n_bytes = X.is_new_entry(F.col("line")), X.line_bytes(F.col("value"))
    kept = F.lit(True) if keep_blank else new | ~X.is_blank(F.col("line"))

    upto = Window.partitionBy(*_SPLIT).orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(
        *_SPLIT,
        "row_id",
        "line",
        kept.alias("kept"),
        F.sum(new.cast("long")).over(upto).alias("local_seq"),
        (F.sum(n_bytes).over(upto) - n_bytes).alias("byte_pos"),
        F.row_number().over(Window.partitionBy(*_SPLIT).orderBy("row_id")).alias("line_pos"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("row_id", "line")))
    own = (
        placed.filter("kept")
        .groupBy(*_SPLIT, "local_seq")
        .agg(
            F.min("byte_pos").alias("byte_pos"),
            F.min("line_pos").alias("line_pos"),
            F.transform(in_order, lambda r: r["line"]).alias("own"),
        )
    )
    index = _split_index(rows, files, kept).hint("shuffle_hash")
    entries = (
        own.join(index, list(_SPLIT))
        # Other head lines have moved to the entry they continue.
        .filter((F.col("local_seq") > 0) | F.col("opens_file"))
    )
    block = F.when(F.col("local_seq") == F.col("n_new"), F.concat("own", "carry")).otherwise(F.col("own"))
    entries = entries.select(
        "service",
        "file_path",
        (F.col("base_seq") + F.col("local_seq")).alias("entry_seq"),
        (F.col("base_lines") + F.col("line_pos")).alias("line_number"),
        (F.col("base_bytes") + F.col("byte_pos")).alias("file_offset"),
        F.array_join(block, "\n").alias("raw_line"),
    )
    return entries if keep_orphan else entries.filter(F.col("entry_seq") > 0)
