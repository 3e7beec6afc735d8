"""Lines that several documents share stay in the first document that has them.

Two Bloom filters over hashes of lines find the suspects: a hash whose bits the once-seen filter already has goes to the
twice-seen filter. Every line of two documents is in the second filter; of the others few are. Only suspected lines are
shuffled, as digests, to be confirmed and to find the first document of each.

The filters are cut into shards by hash, so they grow with the lines: a task sends each shard the hashes that it saw, each
once, and whether it saw them in several documents. Where the twice-seen filter fits ``broadcast_bytes`` all workers
hold it and lines are tested where they lie; beyond that, lines go to the shards, and a shard with many lines is copied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logframe.llm.common import unused, written

#: Code points that a line needs to be looked at.
MIN_LENGTH = 10
#: Bits of a filter for each line, and how many of them a hash sets: below 1 % of single lines become suspects.
BITS, PROBES = 12, 4
#: Lines of a shard, and the least number of shards.
SHARD_LINES, MIN_SHARDS = 1 << 20, 64
#: Size up to which workers hold the twice-seen filter.
BROADCAST_BYTES = 64 << 20
#: Hashes that a task holds before it sends them.
HELD = 1 << 21
#: Lines that one copy of a shard tests.
COPY_LINES = 4 << 20

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """What lines are compared by: white space off both ends, A-Z in lower case; None for short lines."""
    key = line.strip(_SPACE)
    return key.encode().lower() if len(key) >= MIN_LENGTH else None


def _keys(text: str | None) -> list[bytes]:
    """The keys of a text, each once."""
    return list(dict.fromkeys(k for k in map(line_key, (text or "").split("\n")) if k is not None))


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class _Shape:
    """How hashes spread over shards and bits."""

    def __init__(self, lines: int, shard_lines: int):
        self.shards = max(MIN_SHARDS, -(-lines // shard_lines))
        self.bits = 8 * -(-BITS * lines // (8 * self.shards)) + 1024

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return (mixed % np.uint64(self.shards)).astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """(n, PROBES) bits of each hash within its shard."""
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return ((low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(self.bits)).astype(np.int64)

    @property
    def size(self) -> int:
        return self.shards * self.bits // 8


def _seen(shape: _Shape):
    """For each shard the hashes of a run of documents: all of them, those of several documents, and how many lines."""
    names = ["shard", "once", "twice", "lines"]

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        shard = shape.shard(hashes)
        order = np.argsort(shard, kind="stable")
        hashes, counts, shard = hashes[order], counts[order], shard[order]
        found, first = np.unique(shard, return_index=True)
        rows = [
            (int(s), hashes[lo:hi].tobytes(), hashes[lo:hi][counts[lo:hi] > 1].tobytes(), int(counts[lo:hi].sum()))
            for s, lo, hi in zip(found, first, [*first[1:], len(hashes)])
        ]
        arrow = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                found = _hashes(_keys(text.as_py()))
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= HELD:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    return seen


def _filtered(shape: _Shape):
    """The twice-seen filter of each shard, from rows in order of shard."""

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lines = None, 0
        once = twice = None

        def closed() -> pa.RecordBatch:
            bits = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "bits": [bits], "lines": [lines]})

        for batch in batches:
            for at, *raw, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != shard:
                    if shard is not None:
                        yield closed()
                    shard, lines = at, 0
                    once, twice = np.zeros(shape.bits, bool), np.zeros(shape.bits, bool)
                places, repeated = (shape.places(np.frombuffer(r, np.uint64)) for r in raw)
                twice[places[once[places].all(axis=1)]] = True
                twice[repeated] = True
                once[places] = True
                lines += n
        if shard is not None:
            yield closed()

    return filters


def twice_filter(docs: DataFrame, shape: _Shape) -> DataFrame:
    """The twice-seen filter: shard, its bits, and how many lines the shard saw."""
    sent = docs.select("text").mapInArrow(_seen(shape), "shard int, once binary, twice binary, lines long")
    dealt = sent.repartition("shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(_filtered(shape), "shard int, bits binary, lines long"), "line-filter")


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _suspected(shape: _Shape, held, schema: pa.Schema):
    """Rows (text last) with the digests of their suspected lines, by the filter that the worker holds."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            keys = list(map(_keys, batch.column(batch.num_columns - 1).to_pylist()))
            flat = [k for own in keys for k in own]
            hashes = _hashes(flat)
            shard, places = shape.shard(hashes)[:, None], shape.places(hashes)
            hit = ((bits[shard, places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1).tolist() if len(flat) else []
            found, at = [], 0
            for own in keys:
                found.append([_digest(k) for k, h in zip(own, hit[at : at + len(own)]) if h])
                at += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, schema.field(len(schema) - 1).type)], schema=schema)

    return test


def _sent_lines(shape: _Shape, copies):
    """Every line to a copy of its shard: row, doc_id, digest and hash."""
    names = ["row", "doc_id", "digest", "hash", "shard", "copy"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, turn = copies.value, 0
        for batch in batches:
            keys = list(map(_keys, batch.column(2).to_pylist()))
            row = np.repeat(np.arange(batch.num_rows), list(map(len, keys)))
            flat = [k for own in keys for k in own]
            hashes = _hashes(flat)
            shard = shape.shard(hashes)
            # Lines take turns, so that equal ones spread over the copies.
            copy = ((turn + np.arange(len(flat))) % many[shard]).astype(np.int32) if len(flat) else np.empty(0, np.int32)
            turn += len(flat)
            own = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
            columns = [*own, pa.array(list(map(_digest, flat)), pa.binary()), pa.array(hashes.view(np.int64)), pa.array(shard), pa.array(copy)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return send


def _tested(shape: _Shape):
    """Lines whose hash the filter has; the filter's row comes before the lines of its shard and copy."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            filters = batch.column("bits")
            first = [i for i in range(batch.num_rows) if filters[i].is_valid]
            for lo, hi in zip([0, *first], [*first, batch.num_rows]):
                if lo < hi:
                    if filters[lo].is_valid:
                        bits, lo = np.frombuffer(filters[lo].as_py(), np.uint8), lo + 1
                    lines = batch.slice(lo, hi - lo)
                    places = shape.places(lines.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                    hit = ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)
                    yield lines.select(["row", "doc_id", "digest"]).filter(pa.array(hit, pa.bool_()))

    return test


def _pairs_by_shard(rows: DataFrame, filters: DataFrame, shape: _Shape, row: str, copy_lines: int) -> DataFrame:
    """Suspected lines of all rows (row, doc_id, digest) where the filter is too large to be held by every worker."""
    spark = rows.sparkSession
    many = np.ones(shape.shards, np.int64)
    for r in filters.select("shard", "lines").collect():  # a number for each shard
        many[r.shard] = -(-r.lines // copy_lines)
    send = _sent_lines(shape, spark.sparkContext.broadcast(many))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {doc_type}, digest binary, hash long, shard int, copy int"
    lines = rows.select(row, "doc_id", "text").mapInArrow(send, schema).withColumn("bits", F.lit(None).cast("binary"))
    last = F.ceil(F.col("lines") / copy_lines).cast("int") - 1
    copied = filters.select("shard", "bits", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    both = lines.unionByName(copied, allowMissingColumns=True)
    dealt = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("bits").isNull())
    return dealt.mapInArrow(_tested(shape), f"row long, doc_id {doc_type}, digest binary")


def _without(schema: pa.Schema):
    """Texts without the lines of their dropped digests (the last column), and how many lines those were."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            kept, counts = [], []
            for text, digests in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
                lines, gone = (text or "").split("\n"), set(digests)
                stay = [x for x in lines if (k := line_key(x)) is None or _digest(k) not in gone]
                kept.append("\n".join(stay))
                counts.append(len(lines) - len(stay))
            columns = [*batch.columns[: n - 2], pa.array(kept, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return drop


def _line_count(text: str) -> Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def dedup_lines(
    docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES,
    shard_lines: int = SHARD_LINES, copy_lines: int = COPY_LINES,
) -> DataFrame:
    """Texts without the lines that a document with a smaller doc_id has as well.

    Lines are the parts of a text between ``\\n``. They are compared without white space at their ends and with A-Z in lower
    case; lines of fewer than ``MIN_LENGTH`` code points stay. Returns the ``keep`` columns with n_lines (before), n_dropped
    and kept_text. A line that a document repeats stays as often where the document is the first to have it, and goes
    altogether where it is not.

    A null or empty text is one empty line. Rows of one doc_id are one document, and so are those with a null doc_id, which
    come after all others. Very long texts and lines are looked at whole. Other columns of any name are left alone. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    lines = docs.agg(F.sum(_line_count("text"))).first()[0] or 0
    shape = _Shape(lines, shard_lines)
    filters = twice_filter(docs, shape)
    wanted = [*dict.fromkeys(["doc_id", *keep])]
    row, suspects = unused("row", docs), unused("suspects", docs)
    source = docs.select(*wanted, "text")
    if shape.size <= broadcast_bytes:
        bits = np.zeros((shape.shards, shape.bits // 8), np.uint8)
        for r in filters.select("shard", "bits").toLocalIterator():  # at most broadcast_bytes
            bits[r.shard] = np.frombuffer(r.bits, np.uint8)
        schema = source.withColumn(suspects, F.array(F.lit(b""))).schema
        tested = source.mapInArrow(_suspected(shape, spark.sparkContext.broadcast(bits), to_arrow_schema(schema)), schema)
        rows = written(tested.withColumn(row, F.monotonically_increasing_id()), "line-rows")
        pairs = rows.select(F.col(row).alias("row"), "doc_id", F.explode(suspects).alias("digest"))
        suspected = F.size(suspects) > 0
    else:
        rows = written(source.withColumn(row, F.monotonically_increasing_id()), "line-rows")
        pairs = written(_pairs_by_shard(rows, filters, shape, row, copy_lines), "line-suspects")
        suspected = F.lit(True)
    drops = _drops(pairs)
    added = [_line_count("text").alias("n_lines"), F.col("text")]
    names = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_lines long, kept_text string, n_dropped long"])
    out = spark.createDataFrame([], names).schema
    found = rows.filter(suspected).join(drops.select(F.col("row").alias(row), "digests"), row, "left")
    columns = [F.col(f"`{c}`") for c in keep]
    whole = F.coalesce(F.col("text"), F.lit("")).alias("kept_text")
    cut = found.filter(F.col("digests").isNotNull()).select(*columns, *added, "digests").mapInArrow(_without(to_arrow_schema(out)), out)
    same = [found.filter(F.col("digests").isNull()), rows.filter(~suspected)]
    for part in same:
        cut = cut.unionByName(part.select(*columns, added[0], whole, F.lit(0).cast("long").alias("n_dropped")))
    return cut


def _drops(pairs: DataFrame) -> DataFrame:
    """For each row the digests of its lines that another document had first."""
    ids = F.col("doc_id")
    firsts = pairs.groupBy("digest").agg(
        F.min(ids).alias("first"), F.max(ids).alias("last"), F.count(ids).alias("named"), F.count("*").alias("all")
    )
    shared = (F.col("first") != F.col("last")) | ((F.col("named") > 0) & (F.col("named") < F.col("all")))
    # Written, so that the join below deals both sides by itself and can split a line that very many documents have.
    confirmed = written(firsts.filter(shared).select("digest", "first"), "line-firsts")
    gone = pairs.join(confirmed, "digest").filter(~ids.eqNullSafe(F.col("first")))
    return gone.groupBy("row").agg(F.collect_list("digest").alias("digests"))
