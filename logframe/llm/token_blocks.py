"""Token ids in patched frame-of-reference blocks.

A block holds 256 ids as differences from its smallest id. They are packed at the width that 90 % of them need; the
others go to a list of exceptions (position, difference). Layout of a block, all little-endian:

    u32 smallest id | u8 width | u8 zero | u16 ids | u16 exceptions | u16 zero | 8*width u32 packed words |
    exceptions u16 positions | exceptions u32 differences

Packing takes 32 ids at a time into ``width`` words, lowest bits first. A segment is a run of blocks with the byte at
which each starts, so a reader decodes only the blocks that it needs. Segments are rows of a Parquet table, written by
Spark's committer: a lost executor costs its tasks and leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logframe.llm.common import work_path
from logframe.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

BLOCK = 256
#: Share of a block's ids that its width must hold.
PERCENTILE = 0.9
#: Ids in a segment: a document that would pass it starts a new one, and only a longer document spans several.
SEGMENT = 65_536

_HEADER = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("n", "<u2"), ("exceptions", "<u2"), ("zero2", "<u2")])
_POWERS = 1 << np.arange(33, dtype=np.uint64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 256) differences to (m, 8 * width) words."""
    groups = values.reshape(-1, 32).astype(np.uint64)
    words = np.zeros((len(groups), width + 1), np.uint64)
    for i in range(32):
        at, shift = divmod(i * width, 32)
        moved = groups[:, i] << np.uint64(shift)
        words[:, at] |= moved & np.uint64(0xFFFFFFFF)
        words[:, at + 1] |= moved >> np.uint64(32)
    return words[:, :width].astype("<u4").reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(m, 8 * width) words to (m, 256) differences."""
    groups = np.zeros((len(words) * 8, width + 1), np.uint64)
    groups[:, :width] = words.reshape(-1, width)
    out, mask = np.empty((len(groups), 32), np.uint32), np.uint64((1 << width) - 1)
    for i in range(32):
        at, shift = divmod(i * width, 32)
        out[:, i] = ((groups[:, at] | groups[:, at + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and block starts (u32 each) of a run of ids."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", b""
    sizes = np.full(count, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (count - 1)
    square = np.full(count * BLOCK, ids[-1], np.uint32)
    square[: len(ids)] = ids
    square = square.reshape(count, BLOCK)
    low = square.min(axis=1)
    rest = square - low[:, None]
    rank = int(np.ceil(BLOCK * PERCENTILE)) - 1
    width = np.searchsorted(_POWERS, np.partition(rest, rank, axis=1)[:, rank].astype(np.uint64), side="right")
    beyond = rest > (_POWERS[width] - 1).astype(np.uint32)[:, None]
    beyond[-1, sizes[-1] :] = False
    header = np.zeros(count, _HEADER)
    header["low"], header["width"], header["n"], header["exceptions"] = low, width, sizes, beyond.sum(axis=1)
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        if w:
            chosen = np.flatnonzero(width == w)
            for k, words in zip(chosen, _pack(rest[chosen] & np.uint32(_POWERS[w] - 1), int(w))):
                packed[k] = words.tobytes()
    parts, starts, at = [], [], 0
    heads, exceptions = header.tobytes(), header["exceptions"]
    for k in range(count):
        where = np.flatnonzero(beyond[k]) if exceptions[k] else None
        tail = b"" if where is None else where.astype("<u2").tobytes() + rest[k, where].astype("<u4").tobytes()
        block = heads[k * 12 : k * 12 + 12] + packed[k] + tail
        starts.append(at)
        at += len(block)
        parts.append(block)
    return b"".join(parts), np.array(starts, "<u4").tobytes()


def decode_blocks(payload: bytes, block_starts: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks from first to before last."""
    starts = np.frombuffer(block_starts, "<u4")[first:last].astype(np.int64)
    if not len(starts):
        return np.empty(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    header = raw[starts[:, None] + np.arange(12)].copy().view(_HEADER).reshape(-1)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(header["width"]):
        if w:
            chosen = np.flatnonzero(header["width"] == w)
            words = raw[starts[chosen][:, None] + 12 + np.arange(32 * int(w))].copy().view("<u4")
            out[chosen] = _unpack(words, int(w))
    for k in np.flatnonzero(header["exceptions"]):
        n, at = int(header["exceptions"][k]), int(starts[k]) + 12 + 32 * int(header["width"][k])
        where = np.frombuffer(payload, "<u2", n, at)
        out[k, where] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    out += header["low"][:, None]
    size = int(header["n"].sum())
    return out.reshape(-1)[:size]


def read_ids(payload: bytes, block_starts: bytes, start: int, length: int) -> np.ndarray:
    """Some ids of a segment; only the blocks that hold them are decoded."""
    first, last = start // BLOCK, -(-(start + length) // BLOCK)
    return decode_blocks(payload, block_starts, first, last)[start - first * BLOCK :][:length]


_ENTRY = "ordinal array<long>, doc_id array<long>, doc_start array<long>, doc_length array<long>"
SEGMENT_SCHEMA = f"shard int, segment int, first long, n long, block_starts binary, payload binary, {_ENTRY}"


def _segments(path: str, end_id: int):
    arrow = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    names = ["shard", "segment", "first", "n", "block_starts", "payload", "ordinal", "doc_id", "doc_start", "doc_length"]
    end = np.array([end_id], "<u4").tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), encoder(path)
        total = segment = ordinal = 0
        held: list[bytes] = []
        entries: list[tuple] = []
        first = size = 0

        def close() -> tuple:
            payload, starts = encode_blocks(np.frombuffer(b"".join(held), "<u4"))
            return (shard, segment, first, size, starts, payload, *map(list, zip(*entries)))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.encode(text) + end
                n = len(ids) // 4
                if entries and size + n > SEGMENT:
                    yield batch([close()])
                    segment, first, size, held, entries = segment + 1, total, 0, [], []
                entry = (ordinal, doc_id, total, n)
                for at in range(0, n, SEGMENT):
                    part = ids[4 * at : 4 * (at + SEGMENT)]
                    held.append(part)
                    entries.append(entry)
                    size += len(part) // 4
                    if at + SEGMENT < n:
                        yield batch([close()])
                        segment, first, size, held, entries = segment + 1, total + at + SEGMENT, 0, [], []
                total, ordinal = total + n, ordinal + 1
        if entries:
            yield batch([close()])

    return write


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> None:
    """Write the ids of all documents (doc_id, text), an end id after each, in ascending doc_id order.

    Shards are ranges of doc_id, dealt by one shuffle; a shard is one task's run of segments. A null text is empty, a
    null doc_id comes first, documents of equal doc_id follow one another by text, repeated rows stay repeated.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(_segments(tokenizer_path(tokenizer), end_id), SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


_PART_SCHEMA = "shard int, ordinal long, doc_id long, doc_start long, n_tokens long, at long, length long, crc long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), *[pa.int64()] * 7]
    names = [f.split()[0] for f in _PART_SCHEMA.split(", ")]
    for b in batches:
        for row in range(b.num_rows):
            c = {n: b.column(n)[row].as_py() for n in b.schema.names}
            ids = decode_blocks(c["payload"], c["block_starts"]).astype("<u4", copy=False)
            raw, rows = memoryview(ids.tobytes()), []
            for ordinal, doc_id, start, n in zip(c["ordinal"], c["doc_id"], c["doc_start"], c["doc_length"]):
                a, z = max(start, c["first"]), min(start + n, c["first"] + c["n"])
                crc = zlib.crc32(raw[4 * (a - c["first"]) : 4 * (z - c["first"])])
                rows.append((c["shard"], ordinal, doc_id, start, n, a - start, z - a, crc))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def crc32_combine(first: int, second: int, length: int) -> int:
    """The crc32 of two runs of bytes one after the other; length: bytes of the second."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # a zero bit more
    for _ in range(3):
        step = [times(step, r) for r in step]
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, r) for r in step]
        length >>= 1
    return first ^ second


def _joined_crc(parts: list | None) -> int | None:
    if parts is None:
        return None
    crc = parts[0]["crc"]
    for p in parts[1:]:
        crc = crc32_combine(crc, p["crc"], 4 * p["length"])
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a written table: doc_id, start among all ids, n_tokens, ids_crc32, from the decoded blocks.

    Segments are decoded where they lie; only numbers are shuffled. The parts of a document that spans segments are
    put together by their checksums.
    """
    segments = read_segments(spark, path)
    shards = segments.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each shard
    found = segments.mapInArrow(_parts, _PART_SCHEMA)
    whole = found.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("doc_start").alias("doc_start"), F.first("n_tokens").alias("n_tokens"),
        F.count("*").alias("parts"), F.min("crc").alias("crc"), F.sort_array(F.collect_list(F.struct("at", "length", "crc"))).alias("list"),
    )
    columns = ["doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens"]
    # Python sees every row, whatever stands around it: rows of one part have nothing for it
    several = F.udf(_joined_crc, LongType())(F.when(F.col("parts") > 1, F.col("list")))
    crc = F.when(F.col("parts") == 1, F.col("crc")).otherwise(several).alias("ids_crc32")
    return whole.join(bases, "shard").select(*columns, crc)


def token_blocks(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> DataFrame:
    """Write all documents to a new table in the shared folder and read it back; see the two functions above."""
    path = work_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
