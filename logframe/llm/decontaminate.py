"""Benchmark decontamination by template windows, in DataFrame operations only.

Text becomes a list of lower-case words in which numbers, names (capitalised words inside a sentence) and units (after a
number) are typed placeholders. Windows of 8 such tokens are hash-joined between documents and benchmark items, so a
question asked again with other numbers or names is found like a copy. A document holds an item if it has at least half
of the item's windows or a run of RUN tokens of it, and if the slots agree: along one alignment, one value of the item
stands for one value of the document.

Beside the templates stands an exact join on words: a document also holds an item of more than RUN words if it has RUN
of them in a row, and a shorter one without windows, such as a few words or numbers only, if it has all of it in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import unused, written

#: Tokens in a window. Items with fewer tokens, but at least the second number, are held by windows of that.
WINDOWS = (8, 4)
#: Share of an item's windows that a document must have.
SHARE = 0.5
#: Tokens in a row that tell an item of any length, by template or word by word; a power of two.
RUN = 16
#: Tokens of a window that must not be placeholders, as a share of it.
LITERAL = 0.5
#: Up to so many windows of the benchmark are broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

NUMBER, NAME, UNIT = "", "", ""
UNITS = "km|cm|mm|kg|mg|ml|min|hours?|days?|weeks?|months?|years?|miles?|meters?|metres?|grams?|liters?|litres?|dollars?|euros?|percent|feet|inches|m|g|l|s|h|%"


def tokens(text: Column, values: bool = False, names: bool = True) -> Column:
    """The tokens of a text; with values, a placeholder is followed by what it stands for; without names, names are words."""
    kept = lambda mark, group: f" {mark}{group if values else ''} "
    clean = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    named = F.regexp_replace(clean, r"(?<=[\p{Ll}\p{N},;]\x20)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", kept(NAME, "$0")) if names else clean
    united = F.regexp_replace(named, rf"(?<=\p{{N}})\x20?({UNITS})(?![\p{{L}}\p{{N}}])", kept(UNIT, "$1"))
    numbered = F.regexp_replace(united, r"\p{N}+", kept(NUMBER, "$0"))
    spaced = F.regexp_replace(F.lower(numbered), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{UNIT}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def literal_tokens(text: Column) -> Column:
    """The words and numbers of a text in lower case."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "), " "), "")


def _with_windows(rows: DataFrame, size: int) -> DataFrame:
    """Replaces ``words`` by ``hashes`` of all windows of a power of two of tokens, each made of two of half the size.

    Every step is a projection of its own: as one expression, each would be evaluated as often as the next names it.
    For the same reason the results are exploded with posexplode_outer: for posexplode Spark would put a test of the
    array's size below all of these projections, written out in full.
    """
    rows, reach = rows.withColumn("hashes", F.transform("words", lambda t: F.xxhash64(t))), 1
    while reach < size:
        later = F.slice("hashes", reach + 1, 2**30)
        rows = rows.withColumn("hashes", F.zip_with("hashes", later, lambda a, b: F.xxhash64(a, b)))
        reach *= 2
    whole = F.slice("hashes", F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0)))
    return rows.withColumn("hashes", whole)


def item_windows(items: DataFrame, size: int, shorter_than: int | None = None) -> DataFrame:
    """hash, item_id, at and n (windows of the item), each window once an item, at its first place.

    Names are placeholders in one reading of an item and words in another, as a copy may be in one case.
    """
    readings = []
    for names in (True, False):
        words = items.select("item_id", tokens(F.col("text"), names=names).alias("words"))
        words = words.filter((F.size("words") >= size) & (F.size("words") < (shorter_than or 2**31 - 1)))
        literal = lambda i: F.size(F.filter(F.slice("words", i + 1, size), lambda t: ~t.rlike(f"^[{NUMBER}-{UNIT}]")))
        hashes = _with_windows(words, size).select("item_id", "words", F.posexplode_outer("hashes").alias("at", "hash"))
        readings.append(hashes.filter(literal(F.col("at")) >= LITERAL * size).select("item_id", "at", "hash"))
    first = reduce(DataFrame.unionByName, readings).groupBy("item_id", "hash").agg(F.min("at").cast("int").alias("at"))
    count = first.groupBy("item_id").agg(F.count_distinct("at").alias("n"))
    return first.join(count, "item_id").select("hash", "item_id", "at", "n")


def _matches(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """doc_id, key, item_id, n, shift and the matched windows of the item, for each alignment of a document and an item."""
    rows = _with_windows(docs.select("doc_id", F.xxhash64("text").alias("key"), tokens(F.col("text")).alias("words")), size)
    exploded = rows.select("doc_id", "key", F.posexplode_outer("hashes").alias("place", "hash"))
    side = F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows
    found = exploded.join(side, "hash")
    group = found.groupBy("doc_id", "key", "item_id", "n", (F.col("place") - F.col("at")).alias("shift"))
    return group.agg(F.collect_set("at").alias("ats"))


def _longest_run(ats: Column, size: int) -> Column:
    """Tokens in the longest row that windows at these places cover without a gap."""
    none = F.struct(F.lit(-(2**30)).alias("start"), F.lit(-(2**30)).alias("last"), F.lit(0).alias("best"))

    def add(state: Column, at: Column) -> Column:
        start = F.when(at - state["last"] <= size, state["start"]).otherwise(at)
        return F.struct(start.alias("start"), at.alias("last"), F.greatest(state["best"], at + size - start).alias("best"))

    return F.aggregate(F.array_sort(ats), none, add, lambda state: state["best"])


def literal_windows(items: DataFrame, told: DataFrame) -> DataFrame:
    """hash, size, item_id, at, whole and n (windows of the item) of the windows that an exact match needs.

    All windows of RUN words for longer items, one of which is enough. Items of up to RUN words that have no
    template windows (are not in ``told``) have their first and last window of the largest power of two of words, which
    cover them; both must be there, at the distance of the item.
    """
    words = written(items.select("item_id", literal_tokens(F.col("text")).alias("words")), "item-words").withColumn("length", F.size("words"))
    runs = _with_windows(words.filter(F.col("length") > RUN), RUN).select("item_id", F.posexplode_outer("hashes").alias("at", "hash"))
    parts = [runs.groupBy("item_id", "hash").agg(F.min("at").alias("at")).withColumn("size", F.lit(RUN)).withColumn("whole", F.lit(False))]
    short = written(words.filter(F.col("length").between(1, RUN)).join(told, "item_id", "left_anti"), "short-items")
    size = 1
    while size <= RUN:
        own = _with_windows(short.filter(F.col("length").between(size, min(2 * size - 1, RUN))), size).select("item_id", F.posexplode_outer("hashes").alias("at", "hash"), "length")
        ends = own.filter((F.col("at") == 0) | (F.col("at") == F.col("length") - size))
        parts.append(ends.select("item_id", "hash", "at", F.lit(size).alias("size"), F.lit(True).alias("whole")))
        size *= 2
    found = written(reduce(DataFrame.unionByName, parts), "item-words")
    return found.join(found.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def _literal(docs: DataFrame, items: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, key, item_id, n_windows and item_windows of exact matches."""
    windows = written(literal_windows(items, told), "literal-windows")
    found = []
    for size, count in sorted(windows.groupBy("size").count().collect()):  # a row for each power of two up to RUN
        rows = _with_windows(docs.select("doc_id", F.xxhash64("text").alias("key"), literal_tokens(F.col("text")).alias("words")), size)
        own = windows.filter(F.col("size") == size).drop("size")
        exploded = rows.select("doc_id", "key", F.posexplode_outer("hashes").alias("place", "hash"))
        hits = exploded.join(F.broadcast(own) if count <= BROADCAST_ROWS else own, "hash")
        # runs count wherever they stand; the ends of a whole item must stand in one alignment
        shift = F.when(F.col("whole"), F.col("place") - F.col("at"))
        held = hits.groupBy("doc_id", "key", "item_id", "whole", "n", shift.alias("shift")).agg(F.count_distinct("at").alias("n_windows"))
        found.append(held.filter(~F.col("whole") | (F.col("n_windows") == F.col("n"))))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_windows bigint, item_windows bigint, key bigint")
    group = reduce(DataFrame.unionByName, found).groupBy("doc_id", "key", "item_id")
    return group.agg(F.max("n_windows").alias("n_windows"), F.max("n").alias("item_windows"))


def _agreeing(docs: DataFrame, items: DataFrame, matches: DataFrame, size: int) -> DataFrame:
    """Matches whose slots agree, with the number of slots and of those with another value."""
    marked = rf"^[{NUMBER}-{UNIT}]"
    words = items.select("item_id", F.posexplode_outer(tokens(F.col("text"), values=True)).alias("slot", "value"))
    slots = words.filter(F.col("value").rlike(marked))
    reach = F.sequence(F.greatest(F.col("slot") - size + 1, F.lit(0)), F.col("slot"))
    wanted = matches.join(slots, "item_id").filter(F.arrays_overlap("ats", reach))
    places = wanted.select("match_no", F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), "value", (F.col("slot") + F.col("shift")).alias("place"))
    held = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), "text")
    held = held.join(places.select(F.col("p_key").alias("k")).distinct(), "k", "left_semi")
    held = held.select("d", "k", F.posexplode_outer(tokens(F.col("text"), values=True)).alias("p", "other"))
    held = held.filter(F.col("other").rlike(marked)).distinct()
    same = F.col("p_id").eqNullSafe(F.col("d")) & (F.col("p_key") == F.col("k")) & (F.col("place") == F.col("p"))
    pairs = places.join(held, same).groupBy("match_no", "value")
    pairs = pairs.agg(F.min("other").alias("low"), F.max("other").alias("high"), F.count("*").alias("times"))
    changed = F.sum(F.when(F.col("low") != F.col("value"), F.col("times")).otherwise(0))
    checked = pairs.groupBy("match_no").agg(
        F.bool_and(F.col("low") == F.col("high")).alias("agrees"), F.sum("times").alias("slots"), changed.alias("changed_slots")
    )
    joined = matches.join(checked, "match_no", "left").filter(F.coalesce("agrees", F.lit(True)))
    return joined.drop("agrees").fillna(0, ["slots", "changed_slots"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document text and benchmark item that it holds: doc_id, item_id, n_windows (of the item, found),
    item_windows, slots, changed_slots, and key (hash of the text, as ids may repeat). Windows are those of the templates,
    or those of words where only the exact join finds the item; that has no slots.

    Documents that hold none give no row; null texts hold none; a null doc_id stays null; repeated rows give one row.
    Null items and those without a word are left out; items of one text are told apart by item_id.
    """
    docs = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("text"))
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    found, told = [], []
    for size, longer in zip(WINDOWS, (None, *WINDOWS)):
        windows = written(item_windows(items, size, longer), "item-windows")
        if windows.isEmpty():
            continue
        told.append(windows.select("item_id"))
        matches = _matches(docs, windows, size).withColumn("match_no", F.monotonically_increasing_id())
        matches = written(matches.withColumn("run", _longest_run(F.col("ats"), size)), "window-matches")
        total = matches.select("doc_id", "key", "item_id", "n", "run", F.explode("ats").alias("at")).groupBy("doc_id", "key", "item_id", "n")
        enough = total.agg(F.count_distinct("at").alias("m"), F.max("run").alias("run")).filter((F.col("m") >= SHARE * F.col("n")) | (F.col("run") >= RUN))
        enough = enough.select(F.col("key").alias("e_key"), F.col("item_id").alias("e_item"), F.col("doc_id").alias("e_id"))
        close = (F.col("key") == F.col("e_key")) & (F.col("item_id") == F.col("e_item")) & F.col("doc_id").eqNullSafe(F.col("e_id"))
        found.append(_agreeing(docs, items, matches.join(enough, close, "left_semi"), size))
    literal = _literal(docs, items, reduce(DataFrame.unionByName, told).distinct() if told else items.select("item_id").limit(0))
    names = ["n_windows", "item_windows", "slots", "changed_slots"]
    none = F.lit(0).cast("long")
    out = literal.select("doc_id", "key", "item_id", F.lit(False).alias("template"), "n_windows", "item_windows", none.alias("slots"), none.alias("changed_slots"))
    if found:
        kept = reduce(DataFrame.unionByName, found).groupBy("doc_id", "key", "item_id", F.col("n").alias("item_windows"))
        kept = kept.agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows"), F.sum("slots").alias("slots"), F.sum("changed_slots").alias("changed_slots"), F.max("run").alias("run")
        )
        kept = kept.filter((F.col("n_windows") >= SHARE * F.col("item_windows")) | (F.col("run") >= RUN))
        out = out.unionByName(kept.withColumn("template", F.lit(True)).drop("run"))
    best = out.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("template", *names)).alias("best"))
    out = best.select("doc_id", "key", "item_id", *(F.col(f"best.{c}").alias(c) for c in names))
    return out.select("doc_id", "item_id", "n_windows", "item_windows", "slots", "changed_slots", "key")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    own, text = unused("c_id", docs), unused("c_key", docs)
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(own), F.col("key").alias(text)).distinct()
    key = F.xxhash64(docs["text"])
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(own)) & (key == F.col(text)), "left_anti")
