"""Column functions on raw log text: entry detection, ANSI removal, trimming, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logframe.functions import patterns as P


def strip_cr(line: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def line_bytes(value: Column) -> Column:
    """Bytes of a line in its file: with a carriage return, if any, and the line end."""
    return (F.octet_length(value) + 1).cast("long")


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(P.SPACE_CHARS)) == ""


def is_new_entry(line: Column) -> Column:
    """True where a line opens an entry, false (never null) elsewhere."""
    return F.coalesce(line.rlike(P.NEW_ENTRY), F.lit(False))


def strip_ansi(text: Column) -> Column:
    cleaned = F.regexp_replace(text, P.ANSI_CODE, "")
    return F.when(F.contains(text, F.lit("\x1b")), cleaned).otherwise(text)


def first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def stack_trace(block: Column) -> Column:
    """Everything after the first line, right-trimmed; null when nothing is left."""
    at = F.instr(block, "\n")
    rest = F.rtrim(F.substring(block, at + 1, F.length(block)), F.lit(P.SPACE_CHARS))
    return F.when((at > 0) & (rest != ""), rest)


def split_block(block: Column) -> Column:
    return F.struct(first_line(block).alias("first_line"), stack_trace(block).alias("stack_trace"))


def trim_all(text: Column) -> Column:
    """Drop spaces and control characters at both ends."""
    return F.btrim(text, F.lit(P.TRIM_CHARS))


def null_if_placeholder(trimmed: Column) -> Column:
    """The placeholder words for "nothing" become null."""
    return F.when(~trimmed.isin(*P.NULL_WORDS), trimmed)


def clean(text: Column) -> Column:
    return null_if_placeholder(trim_all(text))


def split_context(context: Column) -> Column:
    """A user-context bracket as (user, site, tenant); missing parts are null."""
    parts = F.split(context, ",", 3)
    return F.struct(
        clean(F.get(parts, F.lit(0))).alias("user_id"),
        clean(F.get(parts, F.lit(1))).alias("site_id"),
        clean(F.get(parts, F.lit(2))).alias("tenant_id"),
    )


def parse_ts(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` as a zone-less timestamp; an impossible date is null."""
    return text.try_cast("timestamp_ntz")


def iso_fraction(text: Column) -> Column:
    """The fraction of an ISO timestamp, cut or padded to nine digits."""
    return F.rpad(F.rtrim(F.substring_index(text, ".", -1), F.lit("Z")), 9, "0")


def parse_iso_ts(text: Column) -> Column:
    """An ISO timestamp to the microsecond. A trailing Z is dropped, not converted."""
    micros = F.concat(F.substring_index(text, ".", 1), F.lit("."), F.left(iso_fraction(text), F.lit(6)))
    return micros.try_cast("timestamp_ntz")


def iso_nano_rem(text: Column) -> Column:
    """Digits seven to nine of the fraction, which a Spark timestamp cannot hold."""
    return F.right(iso_fraction(text), F.lit(3)).cast("int")


def ts_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` cut to milliseconds, independent of the session time zone."""
    text = ts.cast("timestamp_ntz").cast("string")
    millis = F.left(F.rpad(F.substring(text, 21, 6), 3, "0"), F.lit(3))
    return F.concat(F.left(text, F.lit(19)), F.lit("."), millis)


def has_stack_trace() -> Column:
    stack = F.col("stack_trace")
    return F.coalesce(~is_blank(stack), F.lit(False))


def iso_text(ts: Column, nano_rem: Column | None = None) -> Column:
    """``yyyy-MM-ddTHH:mm[:ss[.fraction]]``: no zero seconds, fraction in groups of three digits.

    ``nano_rem`` has digits seven to nine of the fraction.
    """
    text = ts.cast("timestamp_ntz").cast("string")
    fraction = F.substring(text, 21, 6)
    if nano_rem is not None:
        nanos = F.concat(F.rpad(fraction, 6, "0"), F.lpad(nano_rem.cast("string"), 3, "0"))
        fraction = F.when(F.coalesce(nano_rem, F.lit(0)) > 0, nanos).otherwise(fraction)
    width = F.when(F.length(fraction) > 6, 9).when(F.length(fraction) > 3, 6).otherwise(3)
    seconds = F.left(text, F.lit(19))
    plain = F.when(F.endswith(seconds, F.lit(":00")), F.left(text, F.lit(16))).otherwise(seconds)
    full = F.concat(seconds, F.lit("."), F.rpad(fraction, width, "0"))
    return F.replace(F.when(fraction == "", plain).otherwise(full), F.lit(" "), F.lit("T"))
