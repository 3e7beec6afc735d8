"""Lines to entry blocks where they are read: the text of the logs is not shuffled.

A split's lines come in file order, so its task can join them to blocks by itself, but for two entries: what stands before
its first opening line belongs to an entry of an earlier split, and its last entry may go on in later ones. These edges, and
three numbers for each split, come from a pass of their own and are all that is shuffled. The numbers of the splits before
it give every block its entry number, line and first byte, and tell which splits hold the entries that are wanted, so that
a scan window or a log index cuts the scan and not the entries.

A block is at most so large; a longer entry goes on in further blocks with the same entry number.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.operators.assemble import file_id, file_ids

#: Bytes of a block from which on its entry goes on in a further one.
MAX_BLOCK_BYTES = 16 << 20
#: Splits and files whose numbers are broadcast, some 100 bytes each.
MAX_BROADCAST_ROWS = 4_000_000
#: Higher than any entry number.
LAST_ENTRY = 2**62

_BLANK = rf"\A[{P.SPACE_CHARS}]*\z"
_BLOCK = "file_id long, split_start long, seq long, byte_pos long, line_pos long, text string"
_EDGE = f"{_BLOCK}, n_new long, n_bytes long, n_lines long"
_NUMBERS = ("n_new", "n_bytes", "n_lines")


class _Split:
    """The lines of one split, fed in order. Gives the blocks that no other split has a part in, or the others (edges)."""

    def __init__(self, key: tuple[int, int], edges: bool, keep_blank: bool, limit: int):
        self.key, self.edges, self.keep_blank, self.limit = key, edges, keep_blank, limit
        self.n_new = self.n_bytes = self.n_lines = 0
        self.out: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.held: list[pa.Array] = []
        self.held_bytes, self.long, self.at = 0, False, (0, 0)

    def _block(self) -> tuple:
        text = "\n".join(x for part in self.held for x in part.to_pylist())
        return (self.n_new, *self.at, text)

    def _extend(self, lines: pa.Array, byte_pos: np.ndarray, line_pos: np.ndarray) -> None:
        """Lines of the open entry. One that outgrows the limit is left to the edges, in several blocks."""
        if not len(lines):
            return
        if self.held_bytes > self.limit:
            if self.edges:
                self.out.append(self._block())
            self.held, self.held_bytes, self.long = [], 0, True
        if not self.held:
            self.at = int(byte_pos[0]), int(line_pos[0])
        if self.edges or not self.long:
            self.held.append(lines)
        self.held_bytes += lines.nbytes

    def _close(self, last: bool) -> None:
        if self.held and (self.edges if last or self.long or not self.n_new else not self.edges):
            self.out.append(self._block())
        self._open()

    def feed(self, values: pa.Array) -> Iterator[tuple]:
        """Adds lines; gives columns of whole blocks: entry number, first byte, line, text."""
        line = values
        if pc.any(pc.ends_with(values, "\r")).as_py():
            bare = pc.binary_replace_slice(values.view(pa.binary()), -1, 1 << 40, b"").view(pa.string())
            line = pc.if_else(pc.ends_with(values, "\r"), bare, values)
        new = pc.match_substring_regex(line, P.NEW_ENTRY)
        starts = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        kept = np.arange(len(values))
        if not self.keep_blank:
            blank = pc.match_substring_regex(line, _BLANK)
            if pc.any(blank).as_py():
                kept = np.flatnonzero(~blank.to_numpy(zero_copy_only=False))
                line = line.take(pa.array(kept))
        lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(lengths)
        byte_pos = self.n_bytes + ends - lengths
        line_pos = self.n_lines + 1 + np.arange(len(values))
        cuts = np.searchsorted(kept, starts)
        first = int(cuts[0]) if len(cuts) else len(kept)
        self._extend(line[:first], byte_pos[kept[:first]], line_pos[kept[:first]])
        if len(starts):
            self._close(last=False)
            if len(starts) > 1 and not self.edges:
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), line[: cuts[-1]])
                whole = starts[:-1]
                seq = self.n_new + 1 + np.arange(len(whole))
                yield seq, byte_pos[whole], line_pos[whole], pc.binary_join(lists, "\n")
            self.n_new += len(starts)
            since = int(cuts[-1])
            self._extend(line[since:], byte_pos[kept[since:]], line_pos[kept[since:]])
        self.n_bytes += int(ends[-1])
        self.n_lines += len(values)

    def rows(self) -> Iterator[tuple]:
        """Columns of the blocks that were put together line by line."""
        if self.out:
            *numbers, texts = zip(*self.out)
            self.out = []
            yield *map(np.array, numbers), pa.array(texts, pa.string())


def _blocks(edges: bool, keep_blank: bool, limit: int):
    names = [f.split()[0] for f in (_EDGE if edges else _BLOCK).split(", ")]

    def batch(key: tuple[int, int], seq, byte_pos, line_pos, text, numbers=(None, None, None)) -> pa.RecordBatch:
        n = len(text)
        columns = [pa.array([k] * n, pa.int64()) for k in key]
        columns += [pa.array(x, pa.int64()) for x in (seq, byte_pos, line_pos)]
        columns += [text, *(pa.array([x] * n, pa.int64()) for x in numbers)] if edges else [text]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def finished(split: _Split) -> Iterator[pa.RecordBatch]:
            split._close(last=True)
            for found in split.rows():
                yield batch(split.key, *found)
            if edges:
                none = pa.array([None], pa.string())
                yield batch(split.key, [0], [0], [0], none, (split.n_new, split.n_bytes, split.n_lines))

        for b in batches:
            ids, starts = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            changes = np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])) + 1
            for lo, hi in zip([0, *changes], [*changes, len(ids)]):
                if lo == hi:
                    continue
                key = int(ids[lo]), int(starts[lo])
                if split is None or split.key != key:
                    if split is not None:
                        yield from finished(split)
                    split = _Split(key, edges, keep_blank, limit)
                for found in split.feed(b.column(2)[lo:hi]):
                    yield batch(key, *found)
                for found in split.rows():
                    yield batch(key, *found)
        if split is not None:
            yield from finished(split)

    return run


class BlockScan:
    """The blocks of scanned lines (``read_log_lines``); ``files`` lists the services of each file.

    All readers of the edges need all of their columns and filter none of them, so one shuffle serves them.
    """

    def __init__(self, lines: DataFrame, files: DataFrame, *, keep_blank: bool = False, keep_orphan: bool = True, limit: int = MAX_BLOCK_BYTES):
        self.keep_blank, self.keep_orphan, self.limit = keep_blank, keep_orphan, limit
        self.lines = lines.select(file_id().alias("file_id"), "split_start", "value")
        self.edges = self.lines.mapInArrow(_blocks(True, keep_blank, limit), _EDGE).repartition("file_id")
        self.files = file_ids(files).withColumnRenamed("file_id", "of")

    def written(self, path: str) -> BlockScan:
        """This scan with its edges and files from tables at ``path``, where they are written now.

        For several searches of logs that stay as they are: none but this reads the logs for their edges.
        """
        spark, out = self.lines.sparkSession, copy(self)
        self.edges.write.parquet(f"{path}/edges")
        self.files.write.parquet(f"{path}/files")
        out.edges = spark.read.schema(self.edges.schema).parquet(f"{path}/edges").repartition("file_id")
        out.files = spark.read.schema(self.files.schema).parquet(f"{path}/files")
        return out

    @property
    def splits(self) -> DataFrame:
        """A row for each service and split: opening lines, bytes, lines, and those of the file's splits before it."""
        inside = (
            (F.max("seq") <= F.max("n_new"))
            & (F.max("line_pos") <= F.max("n_lines"))
            & (F.max(F.when(F.col("text").isNotNull(), F.col("byte_pos"))) <= F.max("n_bytes"))
        )
        odd = F.raise_error(F.lit("A log file changed while it was read; read it again"))
        whole = F.when(F.coalesce(inside, F.lit(True)), F.max("n_new")).otherwise(odd).alias("n_new")
        # The lines before the first entry of the file are an entry of their own.
        head = F.max(F.when((F.col("seq") == 0) & F.col("text").isNotNull(), 1).otherwise(0)).alias("head")
        totals = self.edges.groupBy("file_id", "split_start").agg(whole, *[F.max(c).alias(c) for c in _NUMBERS[1:]], head)
        upto = Window.partitionBy("file_id").orderBy("split_start").rowsBetween(Window.unboundedPreceding, 0)
        placed = totals.select("*", *[(F.sum(c).over(upto) - F.col(c)).alias(f"base_{c[2:]}") for c in _NUMBERS])
        late = F.raise_error(F.lit("A log file was written between its listing and the scan; list and read again"))
        path = F.when(F.col("file_path").isNull(), late).otherwise(F.col("file_path"))
        return placed.join(self.files, _id() == F.col("of"), "left").withColumn("file_path", path).drop("of")

    def counts(self) -> DataFrame:
        """A row for each service and file: the number of its first entry (0 for lines before any) and of its last."""
        orphan = (F.max(F.when(F.col("base_new") == 0, F.col("head")).otherwise(0)) > 0) & F.lit(self.keep_orphan)
        first = F.when(orphan, 0).otherwise(1).cast("long").alias("first")
        counts = self.splits.groupBy("file_id", "service", "file_path").agg(first, F.sum("n_new").alias("last"))
        return counts.filter("last >= first")

    def window(self, n: int, oldest: bool) -> DataFrame:
        """The first or last n entries of each service in order of path and place: file_id, service, low and high."""
        toward = F.col("file_path").asc() if oldest else F.col("file_path").desc()
        upto = Window.partitionBy("service").orderBy(toward).rowsBetween(Window.unboundedPreceding, 0)
        size = F.col("last") - F.col("first") + 1
        room = F.lit(n) - (F.sum(size).over(upto) - size)
        found = self.counts().withColumn("room", room).filter("room > 0")
        low, high = F.col("first"), F.least("last", F.col("first") + F.col("room") - 1)
        if not oldest:
            low, high = F.greatest("first", F.col("last") - F.col("room") + 1), F.col("last")
        return found.select("file_id", "service", low.alias("low"), high.alias("high"))

    def blocks(self, wanted: DataFrame | None = None) -> DataFrame:
        """service, file_path, entry_seq, line_number, file_offset and raw_line of all entries, or of those ``wanted``.

        ``wanted`` has ranges (file_id, service, low, high) of entry numbers, disjoint for each file and service. Only the
        splits that hold them pass the scan.
        """
        splits, lines = self.splits, self.lines
        if wanted is not None:
            of = wanted.select(F.col("file_id").alias("w_file"), F.col("service").alias("w_service"), "low", "high")
            same = (_id() == F.col("w_file")) & F.col("service").eqNullSafe(F.col("w_service"))
            # A split also holds lines of the entry that is open where it starts.
            near = (F.col("base_new") <= F.col("high")) & (F.col("base_new") + F.col("n_new") >= F.col("low"))
            splits = splits.join(of, same & near)
            needed = splits.select("file_id", "split_start").distinct()
            lines = lines.join(_checked(needed), ["file_id", "split_start"], "left_semi")
        else:
            splits = splits.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(LAST_ENTRY).cast("long")})
        base = splits.select("file_id", "split_start", "service", "file_path", "base_new", "base_bytes", "base_lines", "low", "high")
        inner = lines.mapInArrow(_blocks(False, self.keep_blank, self.limit), _BLOCK).join(_checked(base), ["file_id", "split_start"])
        inner = inner.select("service", "file_path", "low", "high", *_placed())
        outer = self._joined()
        if wanted is None:
            outer = outer.join(self.files, F.col("key") == F.col("of")).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(LAST_ENTRY).cast("long")})
        else:
            outer = outer.join(self.files, F.col("key") == F.col("of"))
            outer = outer.join(of, (F.col("key") == F.col("w_file")) & F.col("service").eqNullSafe(F.col("w_service")))
        found = inner.unionByName(outer.select(*inner.columns))
        found = found.filter(F.col("entry_seq").between(F.col("low"), F.col("high")))
        found = found if self.keep_orphan else found.filter(F.col("entry_seq") > 0)
        return found.drop("low", "high")

    def _joined(self) -> DataFrame:
        """The entries at the edges of splits, put together: key (their file), and what ``_placed`` gives."""
        # The numbers of earlier splits, as the rows of a split stand beside one another.
        before = Window.partitionBy("file_id").orderBy("split_start").rangeBetween(Window.unboundedPreceding, -1)
        rows = self.edges.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c[2:]}") for c in _NUMBERS])
        rows = rows.filter(F.col("text").isNotNull()).select(_id().alias("key"), *_placed())
        # Ordered by both numbers, so that all columns are needed whatever the reader asks for.
        in_entry = Window.partitionBy("key", "entry_seq").orderBy("file_offset", "line_number").rowsBetween(Window.unboundedPreceding, -1)
        size = F.octet_length("raw_line").cast("long")
        parts = rows.withColumn("part", F.floor(F.coalesce(F.sum(size).over(in_entry), F.lit(0)) / self.limit))
        pieces = F.sort_array(F.collect_list(F.struct("file_offset", "raw_line")))
        return parts.groupBy("key", "entry_seq", "part").agg(
            F.min("line_number").alias("line_number"),
            F.min("file_offset").alias("file_offset"),
            F.array_join(F.transform(pieces, lambda p: p["raw_line"]), "\n").alias("raw_line"),
        )


def _id() -> Column:
    """The file of a row of the edges as a join key that lets no filter sink into their shuffle."""
    return F.coalesce(F.col("file_id"), F.lit(0))


def _placed() -> list[Column]:
    return [
        (F.col("base_new") + F.col("seq")).alias("entry_seq"),
        (F.col("base_lines") + F.col("line_pos")).alias("line_number"),
        (F.col("base_bytes") + F.col("byte_pos")).alias("file_offset"),
        F.col("text").alias("raw_line"),
    ]


def _checked(small: DataFrame) -> DataFrame:
    """A frame of some numbers for each split or file, to be broadcast; more rows than that end the job."""
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    many = F.raise_error(F.lit(f"More than {MAX_BROADCAST_ROWS} splits: raise spark.sql.files.maxPartitionBytes or read fewer logs"))
    key = F.when(F.col("_total") > MAX_BROADCAST_ROWS, many).otherwise(F.col(small.columns[0]))
    return F.broadcast(small.withColumn("_total", total).withColumn(small.columns[0], key).drop("_total"))
