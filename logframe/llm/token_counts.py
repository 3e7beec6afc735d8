"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table of the most frequent pre-tokens of the corpus and their lengths in tokens. Every
task counts the pre-tokens of its own documents and hands on one summary row; the summaries, never pre-tokens, are
merged in two steps. The second tier is each worker's bounded cache, filled by the tokenizers library. The table only
saves work: counts do not depend on what it holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import written
from logframe.llm.tokens import DEFAULT_TOKENIZER, encoder, pieces_of, plain, tokenizer_path

#: The broadcast table has at most so many pre-tokens of at most so many characters: under 8 MB in a worker.
FREQUENT, LONGEST = 32_768, 32
#: A task's summary keeps so many pre-tokens, and is cut to them whenever it holds eight times as many.
SUMMARY = 16_384

_SUMMARY_SCHEMA = "pieces array<string>, counts array<long>"


def _summary_batch(counts: Counter, most: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
    columns = [pa.array([[p for p, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["pieces", "counts"])


def _cut(counts: Counter) -> Counter:
    return counts if len(counts) <= 8 * SUMMARY else Counter(dict(counts.most_common(SUMMARY)))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and plain(text):
                counts.update(pieces_of(text))
                counts = _cut(counts)
    yield _summary_batch(Counter({p: n for p, n in counts.items() if len(p) <= LONGEST}), SUMMARY)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for pieces, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update(dict(zip(pieces, numbers)))
            counts = _cut(counts)
    yield _summary_batch(counts, FREQUENT)


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """About the most frequent pre-tokens of all documents, at most FREQUENT of them; one row reaches the driver."""
    summaries = written(docs.select(F.col(text).alias("text")).mapInArrow(_summarise, _SUMMARY_SCHEMA), "piece-summaries")
    parts = max(1, math.isqrt(summaries.count()))
    merged = summaries.repartition(parts).mapInArrow(_merge, _SUMMARY_SCHEMA).repartition(1).mapInArrow(_merge, _SUMMARY_SCHEMA)
    rows = merged.collect()
    return rows[0]["pieces"] if rows else []


def token_counts(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, limit: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows; an empty table gives none. Other
    columns of the input, whatever their names, play no part.
    """
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    pieces = frequent_pieces(docs, text)
    coder = encoder(path)
    if pieces:
        coder.learn(pieces)
    table = spark.sparkContext.broadcast({p: len(coder.known[p]) // 4 for p in pieces})
    names = [f"kept{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = table.value.get, encoder(path)
        for batch in batches:
            totals = []
            for t in batch.column(len(names)).to_pylist():
                if plain(t):
                    pieces = pieces_of(t)
                    lengths = list(map(first, pieces))
                    misses = [p for p, n in zip(pieces, lengths) if n is None]
                    totals.append(sum(filter(None, lengths)) + len(second.encode_pieces(misses)) // 4)
                else:
                    totals.append(len(second.encode(t)) // 4)
            columns = [batch.column(i) for i in range(len(names))]
            n_bytes = pa.compute.binary_length(batch.column(len(names))).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, n_bytes, pa.array(totals, pa.int64())], [*names, "n_bytes", "n_tokens"])

    types = {f.name: f.dataType for f in source.schema}
    schema = ", ".join([*(f"{n} {types[n].simpleString()}" for n in names), "n_bytes long", "n_tokens long"])
    counted = source.mapInArrow(count, schema)
    kept: list[Column] = [F.col(n).alias(c) for c, n in zip(keep, names)]
    return counted.select(*kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
