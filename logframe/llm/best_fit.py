"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are encoded where they are read; only (doc_id, piece, start, length, crc) rows go on. Rows are dealt evenly
over partitions of a bounded number of rows, and each partition runs best-fit decreasing. Dual-feasible functions give
a lower bound on each partition's sequences. A partition whose sequences hold more than that, or whose sequences have
room left, hands those back; they are dealt anew over fewer partitions and packed again, until the sequences of all
partitions meet the bound on the whole corpus or a round wins nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import written
from logframe.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

CAPACITY = 4096
#: Pieces in a partition of the packing; a partition is one task.
PARTITION = 65_536
#: A sequence with more room than this share of its capacity is handed back for the next round.
ROOM = 0.005
MAX_ROUNDS = 8

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> DataFrame:
    """Every document's pieces: all its ids and the end id, cut only where they are more than the capacity."""
    path, end = tokenizer_path(tokenizer), np.array([end_id], "<u4").tobytes()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE)], [n for n, _ in _PIECE])

    return source.mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The least sequences that any packing needs, as far as two families of dual-feasible functions tell.

    The first drops lengths below t and lifts those above capacity - t to the whole capacity, for every t up to one
    half; at t = 0 it is the plain sum. The second rounds (k + 1) * length / capacity down, for k up to 20.
    """
    if not len(lengths):
        return 0
    number = np.zeros(capacity + 1, np.int64)
    np.add.at(number, lengths, counts)
    total = number * np.arange(capacity + 1)
    n_sum, t_sum = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(total)])
    t = np.arange(capacity // 2 + 1)
    large = n_sum[-1] - n_sum[capacity - t + 1]
    middle = t_sum[capacity - t + 1] - t_sum[t]
    best = int(np.max(large + -(-middle // capacity)))
    for k in range(1, 21):
        scaled = (k + 1) * np.arange(capacity + 1)
        # in units of capacity * k
        value = np.where(scaled % capacity == 0, np.arange(capacity + 1) * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * number).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, and the room left in each sequence; lengths must descend."""
    room_of: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has exactly r left
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(room_of)
            room_of.append(capacity)
        sequence[i], offset[i] = at, capacity - room
        left = room - size
        room_of[at] = left
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return sequence, offset, np.array(room_of, np.int64)


def _packer(round_no: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema(_PIECE))
        if not rows.num_rows:
            return
        rows = rows.sort_by([("length", "descending"), *((n, "ascending") for n in ("doc_id", "piece", "start", "ids_crc32"))])
        lengths = rows.column("length").to_numpy()
        sequence, offset, room = best_fit_decreasing(lengths, capacity)
        distinct, counts = np.unique(lengths, return_counts=True)
        gap = len(room) - lower_bound(distinct, counts, capacity)
        # no better packing of this partition alone: only what could take in more from others is handed back
        least = capacity * ROOM if gap == 0 else 0
        base = (round_no << 56) + (TaskContext.get().partitionId() << 28)
        for name, values in (("sequence_id", pa.array(base + sequence)), ("offset", pa.array(offset)), ("open", pa.array((room > least)[sequence]))):
            rows = rows.append_column(name, values)
        yield from rows.combine_chunks().to_batches()

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place rows of PIECE_SCHEMA: adds sequence_id and offset (gapless from 0). Equal rows are placed one by one.

    The driver holds counts only, among them one for each length up to the capacity.
    """
    spark = items.sparkSession
    done: list[DataFrame] = []
    sizes = items.groupBy("length").count().collect()
    bound = lower_bound(np.array([r[0] for r in sizes], np.int64), np.array([r[1] for r in sizes], np.int64), capacity)
    left, parts, used = items, max(1, -(-sum(r[1] for r in sizes) // PARTITION)), None
    closed = 0
    for round_no in range(MAX_ROUNDS):
        placed = written(left.repartition(parts).mapInArrow(_packer(round_no, capacity), PLACED_SCHEMA), "packed")
        row = placed.filter("offset = 0").agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
        rows_open = placed.filter("open").count()
        if used is not None and row["n"] >= used[1]:  # the round before was as good
            done.append(used[0])
            break
        total = closed + row["n"]
        closed += row["n"] - row["open"]
        if total <= bound or parts == 1 or not row["open"] or round_no == MAX_ROUNDS - 1:
            done.append(placed)
            break
        done.append(placed.filter("not open"))
        used = (placed.filter("open"), row["open"])
        left = used[0].select(*(n for n, _ in _PIECE))
        parts = min(parts - 1, max(1, -(-rows_open // PARTITION)))
    out = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], PLACED_SCHEMA)
    return out.drop("open")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A null text is empty and has the end id alone; a null doc_id stays null; repeated rows are packed each; an empty
    table gives no rows; other columns play no part.
    """
    return pack(written(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 1) -> DataFrame:
    """The packed ids: sequence_id, ids (array of at most capacity ints). doc_id must be unique here."""
    path = tokenizer_path(tokenizer)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(coder.encode(text) + end, "<u4").astype(np.int32)
                out += [(doc_id, k, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
            if out:
                d, k, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = source.mapInArrow(ids_of, "doc_id long, piece int, ids array<int>")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
