"""Entry blocks to the fixed log-entry table: one map-side projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.functions import text as X
from logframe.schema import ENTRY_COLUMNS

# Slots of the split line: format, ts, level, context or user, site, tenant, trace, span, thread,
# logger, message. The message comes last, so separators inside it are harmless.
_SLOTS = 11
_SLOTS_OF = {
    P.FULL: ("FULL", "$1", "$3", "$4", "$5", "$6", "$8", "$9", "$10", "$11", "$12"),
    P.SLIM: ("SLIM", "$1", "$2", "$3", "", "", "$5", "$6", "$7", "$8", "$9"),
    P.SIMPLE: ("SIMPLE", "$1", "$2", "", "", "", "", "", "", "", "$3"),
    P.ISO: ("ISO", "$1", "$2", "", "", "", "", "", "", "", "$3"),
}
_RAW = ("RAW", "", P.UNKNOWN_LEVEL, *[""] * (_SLOTS - 3))
_SEP = "\x01"


def _separator(line: Column) -> Column:
    """U+0001; for a line that holds it, a separator longer than the line."""
    longer = F.concat(F.lit("\x01"), F.repeat(F.lit("\x02"), F.length(line)), F.lit("\x03"))
    return F.when(F.contains(line, F.lit(_SEP)), longer).otherwise(F.lit(_SEP))


def _template(slots: Sequence[str], sep: Column) -> Column:
    """The slots, each led by the separator."""
    usual = F.lit("".join(_SEP + slot for slot in slots))
    return F.when(sep == _SEP, usual).otherwise(F.replace(usual, F.lit(_SEP), sep))


def _joined(line: Column, sep: Column) -> Column:
    """The line's fields joined by ``sep``, led by ``sep``; an unmatched line comes back as is.

    Each format is one regex pass. A line already rewritten starts with the separator, so the
    patterns after it fail on their first character and the first format that fits wins. Two cheap
    tests that the patterns imply save most of the failing passes: only the ISO format has a T as
    its eleventh character, and only the full one has three dashes.
    """

    def rewrite(text: Column, pattern: str) -> Column:
        return F.regexp_replace(text, F.lit(pattern), _template(_SLOTS_OF[pattern], sep))

    iso = F.substring(line, 11, 1) == "T"
    full = F.contains(line, F.lit("---"))
    first = F.when(iso, rewrite(line, P.ISO)).when(full, rewrite(line, P.FULL)).otherwise(line)
    return rewrite(rewrite(first, P.SLIM), P.SIMPLE)


def parse_entries(df: DataFrame, block: str = "raw_line") -> DataFrame:
    """Parse the ``block`` column into the entry fields; blank and null blocks give no row.

    ``service``, ``line_number``, ``file_offset`` and ``file_path`` are taken over where present.
    """
    carried = [c for c in ("service", "line_number", "file_offset", "file_path") if c in df.columns]
    kept = [*carried, "raw_line"]
    base = df.select(*carried, F.col(block).alias("raw_line"))
    line = base.withColumn("line", X.first_line(F.col("raw_line")))
    line = line.withColumn("line", X.strip_ansi(F.col("line")))
    line = line.withColumn("sep", _separator(F.col("line")))
    line = line.withColumn("joined", _joined(F.col("line"), F.col("sep")))
    joined, sep = F.col("joined"), F.col("sep")
    matched = F.when(F.startswith(joined, sep), joined).otherwise(F.concat(_template(_RAW, sep), F.col("line")))
    parts = F.split(matched, sep, _SLOTS + 1)
    # A one-element explode: filters on parsed fields stay above it, so the regexes run once a row
    # instead of once more per predicate. A blank block explodes to nothing.
    parsed = F.when(~X.is_blank(F.col("raw_line")), F.array(parts))
    split = line.select(*kept, F.explode(parsed).alias("parts"))

    def slot(i: int) -> Column:
        return F.get(F.col("parts"), F.lit(i))

    fmt, slim = slot(1), slot(1) == "SLIM"
    context = split.withColumn("context", F.when(slim, F.split(slot(4), ",", 3)))

    def user(i: int) -> Column:
        return F.when(slim, F.get(F.col("context"), F.lit(i))).otherwise(slot(4 + i))

    cleaned = {
        "user_id": user(0),
        "site_id": user(1),
        "tenant_id": user(2),
        "trace_id": slot(7),
        "span_id": slot(8),
        "thread": slot(9),
        "logger": slot(10),
        "message": slot(11),
    }
    trimmed = context.select(*kept, "parts", *[X.trim_all(c).alias(name) for name, c in cleaned.items()])
    iso = fmt == "ISO"
    fields = {
        "ts": F.when(iso, X.parse_iso_ts(slot(2))).otherwise(X.parse_ts(slot(2))),
        "ts_nano_rem": F.when(iso, X.iso_nano_rem(slot(2))).otherwise(F.lit(0)),
        "level": F.trim(slot(3)),
        **{name: X.null_if_placeholder(F.col(name)) for name in cleaned},
        "stack_trace": X.stack_trace(F.col("raw_line")),
        "log_format": fmt,
    }
    # An unparsed line keeps its text untrimmed.
    fields["message"] = F.when(fmt == "RAW", slot(11)).otherwise(fields["message"])
    fields |= {c: F.col(c) for c in kept}
    return trimmed.select(*[fields[c].alias(c) for c in ENTRY_COLUMNS if c in fields])


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Show only the named columns; the scan then reads only what they need."""
    return df.select(*columns)
