"""Secret scan with linking of credentials in several parts, in DataFrame operations only.

Strong kinds are reported wherever they stand: assign (a keyword, a sign and a value of 8 or more), access (AKIA keys),
hex (32 or more hex digits). Weak kinds (ident, blob, endpoint) are common in harmless text; one is reported only where
a complementary part stands within SCOPE characters of it: a secret by an identifier or an endpoint, an identifier or
an endpoint by a secret. Parts meet by an interval join, binned by place, so a long text is no quadratic work, and a
semi join hands on parts, never pairs.

Spark has no function for the places of matches: the pieces between matches (split) and the matches themselves
(regexp_extract_all) give their lengths, and running sums over those give the places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logframe.llm.common import unused, written

#: Kinds in the order of reports: pattern, group whose length counts, least length, a quick test, role.
_VALUE = "[A-Za-z0-9+/_.=-]"
_GAP = r"""["']?\x20*[:=]\x20*["']?"""
KINDS: dict[str, tuple[str, int, int, str, str]] = {
    "assign": (rf"(?i)(password|passwd|secret|token|api_?key){_GAP}({_VALUE}+)", 2, 8, rf"(?i)(?:passw(?:or)?d|secret|token|api_?key){_GAP}{_VALUE}{{8}}", "secret"),
    "access": ("AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}", "identifier"),
    "hex": ("[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}", "secret"),
    "ident": (rf"(?i)\b(user(?:_?name)?|login|client_?id|account_?id|access_?key_?id){_GAP}([A-Za-z0-9@._-]+)", 2, 3, r"(?i)(?:user|login|client_?id|account_?id|name|key_?id)[\"']?\x20*[:=]", "identifier"),
    "blob": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24, "[A-Za-z0-9+/_-]{24}", "secret"),
    "endpoint": (r"""(?i)\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", 0, 8, "://", "endpoint"),
}
BASE = ("assign", "access", "hex")
#: Characters between parts of one credential at most.
SCOPE = 200
_BIN = 512
_NO = {kind: i for i, kind in enumerate(KINDS)}


def _lengths(kind: str) -> Column:
    """Of every match, in order: the text before it since the last one, the match, and its counted group, in code points."""
    pattern, group, _, quick, _ = KINDS[kind]
    p = F.lit(pattern)
    before = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all("text", p, F.lit(0)), lambda x: F.length(x))
    part = F.transform(F.regexp_extract_all("text", p, F.lit(group)), lambda x: F.length(x)) if group else whole
    one = F.arrays_zip(F.slice(before, F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), part.alias("part"))
    none = F.lit(None).cast("array<struct<before:int,whole:int,part:int>>")
    return F.when(F.col("text").rlike(quick), one).otherwise(none)


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (row_no, doc_id, key) and all parts (row_no, kind_no, start, end), strong and weak.

    The texts are read once and not moved; what goes on is written to the shared folder, as it holds the row numbers.
    """
    scanned = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.xxhash64("text").alias("key")
    rows = written(scanned.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", key, *(_lengths(k).alias(k) for k in KINDS)), "secret-matches")
    parts = []
    for kind, (_, _, least, _, _) in KINDS.items():
        each = rows.filter(F.col(kind).isNotNull()).select("row_no", F.posexplode(kind).alias("at", "m"))
        so_far = Window.partitionBy("row_no").orderBy("at")
        end = F.sum(F.col("m.before") + F.col("m.whole")).over(so_far)
        placed = each.withColumn("end", end).filter(F.col("m.part") >= least)
        parts.append(placed.select("row_no", F.lit(_NO[kind]).alias("kind_no"), (F.col("end") - F.col("m.whole")).alias("start"), "end"))
    return rows.select("row_no", "doc_id", "key"), written(reduce(DataFrame.unionByName, parts), "secret-parts")


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Rows of left with a row of right in the same text at most reach characters away, not overlapping unless reach is 0.

    Both sides are binned by place: left in every bin that its scope touches, right in those that it covers; parts longer
    than a bin are in as many bins as they cover.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / _BIN), F.floor(b / _BIN))).alias("bin")
    low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
    a = left.select("*", bins(low, high)).alias("a")
    b = right.select("row_no", F.col("start").alias("s"), F.col("end").alias("e"), bins(F.col("start"), F.col("end"))).alias("b")
    touch = (F.col("b.s") < F.col("a.end") + reach) & (F.col("b.e") > F.col("a.start") - reach)
    if reach:
        touch &= (F.col("b.s") >= F.col("a.end")) | (F.col("b.e") <= F.col("a.start"))
    same = (F.col("a.row_no") == F.col("b.row_no")) & (F.col("a.bin") == F.col("b.bin"))
    return a.join(b, same & touch, "left_semi").drop("bin").distinct()


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that a complementary part stands by, with the strong parts."""

    def of(role: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
        return parts.filter(F.col("kind_no").isin([_NO[k] for k in kinds if KINDS[k][4] == role]))

    weak = tuple(k for k in KINDS if k not in BASE)
    base = parts.filter(F.col("kind_no").isin([_NO[k] for k in BASE]))
    covered = _near(parts.filter(F.col("kind_no").isin([_NO[k] for k in weak])), base, 0)
    own = parts.join(covered, ["row_no", "kind_no", "start", "end"], "left_anti")
    clear = lambda role: own.filter(F.col("kind_no").isin([_NO[k] for k in weak if KINDS[k][4] == role]))
    strong = lambda role: of(role, BASE)
    secrets = strong("secret").unionByName(clear("secret"))
    others = strong("identifier").unionByName(clear("identifier")).unionByName(clear("endpoint"))
    linked = _near(clear("secret"), others, scope).unionByName(_near(clear("identifier").unionByName(clear("endpoint")), secrets, scope))
    return base.unionByName(linked)


def scan_rows(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every row's doc_id, the key of its text, and spans: array of (start, kind_no, end), by start and kind."""
    rows, parts = find_parts(docs)
    spans = F.sort_array(F.collect_list(F.struct("start", "kind_no", "end"))).alias("spans")
    found = link_parts(parts, scope).groupBy("row_no").agg(spans)
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    return rows.join(found, "row_no", "left").select("doc_id", "key", F.coalesce("spans", none).alias("spans"))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    A null text is empty: no spans, and the digest of the empty string. A null doc_id stays null; repeated rows are
    scanned each; an empty table gives no rows. Spans are in code points, end exclusive.
    """
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    number = lambda k: F.size(F.filter(spans, lambda s: s["kind_no"] == _NO[k])).cast("long").alias(f"n_{k}")
    return scan_rows(docs, scope).select("doc_id", *map(number, BASE), F.sha2(_told(base), 256).alias("base_sha256"), _told(spans).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span, or run of overlapping spans, replaced by a mark; n_chars follows.

    Clean documents stay as they are. Equal rows have equal spans, so the join goes by doc_id and a hash of the text.
    """
    found = scan_rows(docs.select("doc_id", "text"), scope).filter(F.size("spans") > 0).distinct()
    own, key, at = (unused(name, docs) for name in ("f_id", "f_key", "f_spans"))
    found = found.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("spans").alias(at))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key)), "left")
    plain = F.coalesce(docs["text"], F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = plain.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], plain.substr((acc["at"] + 1).cast("int"), F.length(plain)))
    text = F.when(F.col(at).isNull(), docs["text"]).otherwise(F.aggregate(at, start, step, rest))
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns if c != "n_chars"]
    out = joined.select(*columns, *([F.when(F.col(at).isNull(), docs["n_chars"]).otherwise(F.length(text)).cast("long").alias("n_chars")] if "n_chars" in docs.columns else []))
    return out.select(*docs.columns)
