"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct shingles, each a 63-bit hash; its sketch is the K smallest. Equal sets are one node
from the start. Inverted lists of retained values generate candidates, an estimate from the sketch of the union filters
them, and the Jaccard similarity of the full sets decides.

Two documents of the wanted similarity share at least C retained values but for a chance of MISS, so they share one of
the K - C + 1 rarest of each: only those are in the lists, which keeps values of common passages out of them. Candidates
never are all pairs of a list. Rounds compare each member with one leader of the list; the last round compares members
of different components found so far, with sizes, shared shingles and larger sketches as conditions of the join. Pairs
inside a component need no comparison, as the components stay the same without them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import unused, written

SHINGLE, PERCENT, K = 5, 80, 32
#: The chance that a pair of exactly the wanted similarity shares fewer retained values than asked for.
MISS = 1e-7
#: Rounds with leaders go on while they find a link for every so many entries of the lists; this is about cost alone.
WORTH = 100
#: Values of a set that go along into the last round's join: 4 KB at most, and all of a set that has no more.
FAR = 512
#: Up to so many document ids are broadcast (16 MB); beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending: runs of ``size`` words, or all words if they are fewer.

    Words are what stands between ASCII white space, with A-Z in lower case; that is what bytes.lower and bytes.split do.
    """
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        factor = _ODD[i % len(_ODD)] * np.uint64(2 * (i // len(_ODD)) + 1)
        out += hashes[i : n - width + 1 + i] * factor
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return np.unique(out >> np.uint64(1)).astype(np.int64)


def least_overlap(k: int, percent: int) -> int:
    """The most retained values that two sketches of k share but for a chance of MISS."""
    t, total = percent / 100, 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > MISS:
            return max(1, c)
    return k


def _sketcher(size: int, k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            columns = [
                b.column(0),
                b.column(2),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "print", "sketch"])

    return sketch


def _set_maker(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            columns = [b.column(0), pa.array(prints, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "set"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in links (a, b), by alternating large and small stars.

    Each step is two groupings and a join, written to the shared folder; steps grow with the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _overlap(a: Column, b: Column, k: int) -> Column:
    """Of the k smallest values of two sketches' union, how many both have."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b)))


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


class _Linker:
    """Candidates and links among the members of the inverted lists.

    A shingle that only one member has is shared with no other, so ``shared``, the number of the others, bounds every
    overlap from above. Members and pairs for which that bound is too low are left out; it is exact.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, index: DataFrame, size: int, percent: int, k: int):
        self.percent, self.k = percent, k
        self.least = least_overlap(k, percent)
        wanted = index.select(F.col("rep").alias("doc_id")).distinct()
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
        made = texts.mapInArrow(_set_maker(size), "doc_id long, print binary, set array<long>")
        prints = nodes.select(F.col("rep").alias("doc_id"), "print")
        once = made.join(prints, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
        sketch = F.slice("set", 1, k).alias("sketch")
        self.sets = written(once.select(F.col("doc_id").alias("rep"), F.size("set").alias("n"), sketch, "set"), "sets")
        held = self.sets.select("rep", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
        own = held.filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
        # an id with several texts is a member with several sets: no bound for those
        own = own.join(self.sets.groupBy("rep").count().filter("count > 1"), "rep", "left_anti")
        bound = index.join(own, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        self.index = written(bound.filter(100 * F.col("shared") >= percent * F.col("n")), "bounded-lists")

    def reach(self, n_a: Column, shared_a: Column, n_b: Column, shared_b: Column) -> Column:
        """Whether sizes and shared shingles leave room for the wanted similarity."""
        return ((100 + self.percent) * F.least(shared_a, shared_b, n_a, n_b)) >= self.percent * (n_a + n_b)

    def need(self, n: Column) -> Column:
        """The retained values that a set of n shingles must share with any of its near duplicates."""
        return F.least(F.lit(self.least), F.ceil(n * self.percent / 200).cast("int"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough; the sketches are asked first."""
        side = lambda t, x, *c: t.select(F.col("rep").alias(x), *(F.col(y).alias(f"{y}_{x}") for y in c))
        told = pairs.join(side(self.sets, "a", "n", "sketch"), "a").join(side(self.sets, "b", "n", "sketch"), "b")
        likely = _overlap(F.col("sketch_a"), F.col("sketch_b"), self.k) >= self.need(F.greatest("n_a", "n_b"))
        told = told.filter(_near_size(F.col("n_a"), F.col("n_b"), self.percent) & likely).select("a", "b", "n_a", "n_b")
        full = told.join(side(self.sets, "b", "set"), "b").join(side(self.sets, "a", "set"), "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        return full.filter(100 * common >= self.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")

    def with_components(self, found: DataFrame | None) -> DataFrame:
        """The lists that more than one component is in, with each member's."""
        if found is None:
            return self.index.withColumn("component", F.col("rep"))
        own = self.index.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = own.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        return own.join(several.select("value"), "value", "left_semi")

    def with_largest(self, lists: DataFrame) -> DataFrame:
        """Adds ``small``: whether the member is outside the component that most members of its list are in."""
        sizes = lists.groupBy("value", "component").count()
        largest = sizes.groupBy("value").agg(F.max(F.struct("count", "component")).alias("m")).select("value", F.col("m.component").alias("largest"))
        return lists.join(largest, "value").withColumn("small", F.col("component") != F.col("largest")).drop("largest")

    def leader_pairs(self, lists: DataFrame, first: bool) -> DataFrame:
        """Each member with the list's leader: the one with the fewest values of its own, as an original has.

        In later rounds the leader is outside the list's largest component, which has been compared with its own.
        """
        choice = lists if first else self.with_largest(lists).filter("small")
        leaders = choice.groupBy("value").agg(F.min(F.struct("alone", "rep", "component", "n", "shared")).alias("leader"))
        joined = lists.join(leaders, "value").filter(F.col("component") != F.col("leader.component"))
        joined = joined.filter(self.reach(F.col("n"), F.col("shared"), F.col("leader.n"), F.col("leader.shared")))
        return joined.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()

    def cross_pairs(self, lists: DataFrame) -> DataFrame:
        """Members of different components of a list that are likely enough; between small sets, all that are linked.

        The component with most members of a list is only one side of it, so its members do not meet one another. A
        pair is looked at in the first list that both are in. The tests are conditions of the join, from the cheapest
        on, so what does not pass makes no row.
        """
        far = self.sets.select("rep", F.slice("set", 1, FAR).alias("far"))
        mine = lists.groupBy("rep", "n").agg(F.collect_list("value").alias("values"))  # at most k
        rows = self.with_largest(lists).join(mine, ["rep", "n"]).join(far, "rep")
        names = ("rep", "n", "shared", "component", "values", "far")
        a = rows.filter("small").select("value", *(F.col(c).alias(f"{c}_a") for c in names))
        b = rows.select("value", *(F.col(c).alias(f"{c}_b") for c in (*names, "small")))
        once = ~F.col("small_b") | (F.col("rep_a") < F.col("rep_b"))
        first = F.array_min(F.array_intersect("values_a", "values_b")) == a["value"]
        close = self.reach(*map(F.col, ("n_a", "shared_a", "n_b", "shared_b")))
        common, both = F.size(F.array_intersect("far_a", "far_b")), F.col("n_a") + F.col("n_b")
        need = F.least(F.lit(least_overlap(FAR, self.percent)), F.ceil(F.greatest("n_a", "n_b") * self.percent / 200))
        alike = F.when(F.greatest("n_a", "n_b") <= FAR, 100 * common >= self.percent * (both - common)).otherwise(common >= need)
        condition = (a["value"] == b["value"]) & (F.col("component_a") != F.col("component_b")) & once & close & first & alike
        return a.join(b, condition).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _lists(nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """The inverted lists: value, rep, n and alone (how many of the rep's values no other has)."""
    entries = nodes.select("rep", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    values = entries.join(shared, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    kept = F.least("n", F.lit(k))
    need = F.least(F.lit(least_overlap(k, percent)), F.ceil(F.col("n") * percent / 200))
    alone = kept - F.size("v")
    rows = values.withColumn("alone", alone.cast("int")).withColumn("most", (kept - need + 1 - F.col("alone")).cast("int")).filter("most > 0")
    return rows.select("rep", "n", "alone", F.explode(F.slice("v", F.lit(1), F.col("most"))).alias("e")).select("e.value", "rep", "n", "alone")


def _grouped(docs: DataFrame, shingle: int, percent: int, k: int) -> DataFrame:
    """doc_id, key (hash of the text), n and component_id of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = source.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows = written(rows.mapInArrow(_sketcher(shingle, k), "doc_id long, key long, n long, print binary, sketch array<long>"), "sketches")
    linkable = rows.filter("n > 0 and doc_id is not null")
    nodes = linkable.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    index = written(_lists(nodes, percent, k), "lists")
    linker = _Linker(source, nodes, index, shingle, percent, k)

    found = None
    for last in (False, True):
        while True:
            lists = written(linker.with_components(found), "open-lists")
            pairs = linker.cross_pairs(lists) if last else linker.leader_pairs(lists, found is None)
            new = written(linker.confirmed(pairs), "links")
            n = new.count()
            if n:
                old = [] if found is None else [found.select(F.col("id").alias("a"), F.col("component").alias("b"))]
                found = written(components(reduce(DataFrame.unionByName, old, new)), "components")
            if last or not n or n * WORTH < lists.count():
                break

    # the last round has compared all that were still apart, so no further link can join two components
    named = nodes.select("print", "rep")
    if found is not None:
        named = named.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    joined = rows.drop("sketch").join(named, "print", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "key", "n", component.alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; see the contract of the sets above.

    Linked are documents whose sets' intersection is at least ``percent`` hundredths of their union; component_id is the
    smallest doc_id that links reach. Texts that are null or have no words have the empty set and are linked with
    nothing. Rows without a doc_id are linked with nothing: component_id is null and they are kept. Rows of one doc_id
    are one node of the graph if their texts are equal, and repeated rows are returned each.
    """
    rows = _grouped(docs, shingle, percent, k)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id, and of repeated rows one.

    Should texts of one group have that doc_id more than once, the one with the smallest hash stays. Rows without a
    doc_id all stay.
    """
    first = _grouped(docs, shingle, percent, k).filter("doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("key"))
    first_id, first_key, key = (unused(name, docs) for name in ("first_id", "first_key", "key"))
    first = first.select(F.col("doc_id").alias(first_id), F.col("key").alias(first_key))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    chosen = keyed.join(first, (F.col("doc_id") == F.col(first_id)) & (F.col(key) == F.col(first_key)), "left_semi")
    return chosen.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.filter(F.col("doc_id").isNull()))
