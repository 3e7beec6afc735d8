"""Quality rules: counts on words and lines, and bands of n-gram perplexity for each language.

A modified Kneser-Ney model of character 4-grams is counted over all documents of a language. Characters are UTF-16 code
units as they stand in the text, none folded with another, so an n-gram is a 64-bit number: that is its hash, without
collisions. Counts, lower orders and probabilities are grouped and joined by Spark. The most frequent n-grams are broadcast to
score the texts; a text's other n-grams are joined with the model. Log probabilities are whole multiples of 1 / SCALE, so that
a text's sum does not depend on the way.

A document's perplexity must lie in the band of its language: the quartiles over all documents that pass the plain rules,
widened by BAND times their distance on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logframe.llm.common import written

ORDER, CLASSES = 4, 1 << 16
#: Distances between the quartiles that the band reaches beyond them.
BAND = 4.0
#: The least distance between the quartiles of log perplexity that a band is built on.
LEAST_SPREAD = 0.01
#: Documents of null language are a language of their own.
NO_LANGUAGE = "und"
#: At most so many n-grams of all languages, the most frequent ones, are broadcast (12 bytes each).
GROUP = 4_000_000
CHUNK = 2_000_000
SCALE = 1 << 20

_WORD_SPACE = "".join(map(chr, [32, *range(9, 14)]))
_SYMBOLS = "#*$%&|<>"
_GAPS = "array<struct<ngram: bigint, times: bigint>>"


def ngrams(text: str) -> np.ndarray:
    """The n-gram that each character ends; the first ones are preceded by line ends."""
    codes = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    keys = codes[: len(codes) - ORDER + 1].copy()
    for i in range(1, ORDER):
        keys = keys << np.uint64(16) | codes[i : len(codes) - ORDER + 1 + i]
    return keys


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, weights=counts).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw: dict[str, list[np.ndarray]] = {}
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def fold(lang: str) -> None:
        keys, counts = np.unique(np.concatenate(raw.pop(lang)), return_counts=True)
        sums.setdefault(lang, []).append((keys, counts))
        if len(sums[lang]) >= 8:
            sums[lang] = [_sums(sums[lang])]

    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = ngrams(text)
            raw.setdefault(lang, []).append(keys)
            size[lang] = size.get(lang, 0) + len(keys)
            if size[lang] >= CHUNK:
                fold(lang)
                size[lang] = 0
    for lang in list(raw):
        fold(lang)
    for lang, parts in sums.items():
        keys, counts = _sums(parts)
        for at in range(0, len(keys), 50_000):
            k, n = keys[at : at + 50_000], counts[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "ngram", "n"])


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, ngram and n over the whole texts of all documents."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What a count of 0, 1, 2 and 3 or more gives up, from how many n-grams have counts 1 to 4."""
    n = [float((counts == i).sum()) for i in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(min(i, max(0.1, i - (i + 1) * y * n[i] / max(n[i - 1], 1))) for i in (1, 2, 3))])


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the counted n-grams, interpolated with all lower orders; keys must ascend.

    The model of one language in one process: what ``train``, which leaves the work to Spark, is measured by.
    Lower orders count the distinct characters that stand before an n-gram, not how often it stands.
    """
    levels = [(keys.astype(np.uint64), counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        rest, before = np.unique(levels[-1][0] % CLASSES**order, return_counts=True)
        levels.append((rest, before.astype(np.float64)))
    lower_keys, lower = np.arange(CLASSES, dtype=np.uint64), np.full(CLASSES, 1 / CLASSES)
    for order, (k, c) in enumerate(reversed(levels), 1):
        give = _discounts(c)[np.minimum(c, 3).astype(int)]
        context, start = np.unique(k // CLASSES, return_index=True)
        total, given = np.add.reduceat(c, start), np.add.reduceat(give, start)
        at = np.searchsorted(context, k // CLASSES)
        below = lower[np.searchsorted(lower_keys, k % CLASSES ** max(order - 1, 1))]
        lower_keys, lower = k, (c - give) / total[at] + given[at] / total[at] * below
    return np.log(lower).astype(np.float32)


def _last(n: int) -> Column:
    """The last n characters of an n-gram."""
    return F.col("ngram").bitwiseAND(F.lit((1 << 16 * n) - 1))


def _given() -> list[Column]:
    """What counts of 1, 2 and 3 or more give up, over a language's n-grams of one order; see ``_discounts``."""
    n = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    known = (n[0] > 0) & (n[1] > 0)
    cut = [F.least(F.lit(float(i)), F.greatest(F.lit(0.1), F.lit(float(i)) - (i + 1) * y * n[i] / F.greatest(n[i - 1], F.lit(1.0)))) for i in (1, 2, 3)]
    return [F.when(known, c).otherwise(0.5).alias(f"give{i}") for i, c in enumerate(cut, 1)]


def train(counts: DataFrame) -> DataFrame:
    """lang, ngram, n and cost (minus the log probability, times SCALE) of all counted n-grams, as ``kneser_ney`` has them."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", _last(order).alias("ngram")).agg(F.count(F.lit(1)).alias("n")))
    below = None
    for order, level in enumerate(reversed(levels), 1):
        # at most 65,536 rows stand behind the same characters
        rows = level.withColumn("context", F.shiftrightunsigned("ngram", 16))
        same = Window.partitionBy("lang", "context")
        sums = [F.sum("n").over(same).alias("total"), *(F.sum((F.least(F.col("n"), F.lit(3)) == i).cast("long")).over(same).alias(f"of{i}") for i in (1, 2, 3))]
        rows = rows.select("lang", "ngram", "n", *sums).join(level.groupBy("lang").agg(*_given()), "lang")
        own = F.when(F.col("n") == 1, F.col("give1")).when(F.col("n") == 2, F.col("give2")).otherwise(F.col("give3"))
        given = F.col("of1") * F.col("give1") + F.col("of2") * F.col("give2") + F.col("of3") * F.col("give3")
        if below is None:
            lower = F.lit(1 / CLASSES)
        else:
            rows = rows.withColumn("rest", _last(order - 1)).join(below.select("lang", F.col("ngram").alias("rest"), F.col("p").alias("lower")), ["lang", "rest"])
            lower = F.col("lower")
        below = rows.select("lang", "ngram", "n", ((F.col("n") - own) / F.col("total") + given / F.col("total") * lower).alias("p"))
    return below.select("lang", "ngram", "n", F.round(-F.log("p") * SCALE).cast("int").alias("cost"))


def _lines_and_words(text: str) -> tuple[int, int, int, int, int]:
    words = text.split(" ") if _plain_space(text) else _split_words(text)
    words = [w for w in words if w]
    n = len(words)
    repeated = 0
    if n > 3:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size < 2_000_000 else _window_ids(ids)
        _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[where] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= twice
            repeated = int(covered.sum())
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(_WORD_SPACE):
            if line in seen:
                duplicates += 1
            seen.add(line)
    return n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), duplicates, repeated


def _window_ids(ids: np.ndarray) -> np.ndarray:
    pairs = np.unique(ids[:-1] << np.int64(32) | ids[1:], return_inverse=True)[1].astype(np.int64)
    return pairs[:-1] << np.int64(32) | ids[2:]


_TO_BLANK = {ord(c): " " for c in _WORD_SPACE}


def _plain_space(text: str) -> bool:
    return not any(c in text for c in _WORD_SPACE[1:])


def _split_words(text: str) -> list[str]:
    return text.translate(_TO_BLANK).split(" ")


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _costs(known: tuple[np.ndarray, np.ndarray] | None, own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The sum over the n-grams that are known, and the others with their times."""
    own.sort()
    if known is None:
        missing, cost = own, 0
    else:
        keys, costs = known
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        found = keys[at] == own
        cost = int(costs[at[found]].sum(dtype=np.int64))
        missing = own[~found]
    ngram, times = np.unique(missing, return_counts=True)
    return cost, ngram.view(np.int64), times


def _scorer(models, keep: int):
    names = [*(f"kept{i}" for i in range(keep)), "row", "lang", *_BASE, "units", "cost"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: (np.frombuffer(k, "<u8"), np.frombuffer(c, "<i4")) for lang, (k, c) in models.value.items()}
        for b in batches:
            rows, ends, gaps = [], [0], []
            for lang, text in zip(b.column(keep + 1).to_pylist(), b.column(keep + 2).to_pylist()):
                own = ngrams(text)
                cost, ngram, times = _costs(known.get(lang), own)
                rows.append((*_lines_and_words(text), len(own), cost))
                gaps.append((ngram, times))
                ends.append(ends[-1] + len(ngram))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * (len(_BASE) + 2))]
            parts = [np.concatenate([np.zeros(0, np.int64), *(g[i] for g in gaps)]) for i in (0, 1)]
            pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["ngram", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep + 2)), *columns, lists], [*names, "gaps"])

    return score


def scored(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the language, the plain counts and the log perplexity a character (null for an empty text)."""
    spark = docs.sparkSession
    model = written(train(written(ngram_counts(docs), "ngram-counts")), "ngram-model")
    whole = model.count() <= GROUP
    top = model if whole else model.orderBy(F.desc("n"), "lang", "ngram").limit(GROUP)
    held: dict[str, tuple[bytes, bytes]] = {}
    found = top.select("lang", "ngram", "cost").toArrow()  # at most GROUP rows
    for lang in found.column("lang").unique().to_pylist():
        rows = found.filter(pc.equal(found.column("lang"), lang))
        keys = rows.column("ngram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        held[lang] = keys[order].astype("<u8").tobytes(), rows.column("cost").to_numpy()[order].astype("<i4").tobytes()
    shared = spark.sparkContext.broadcast(held)
    names = [f"kept{i}" for i in range(len(keep))]
    source = docs.select(
        *(F.col(c).alias(n) for c, n in zip(keep, names)),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"{n} {types[n]}" for n in [*names, "row", "lang"]), *(f"{c} long" for c in [*_BASE, "units", "cost"]), f"gaps {_GAPS}"])
    out = source.mapInArrow(_scorer(shared, len(keep)), schema)
    if not whole:
        out = written(out, "scores")
        gaps = out.select("row", "lang", F.inline("gaps")).join(model.select("lang", "ngram", F.col("cost").alias("each")), ["lang", "ngram"])
        more = gaps.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
        out = out.join(more, "row", "left").withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0)))
    mean = F.when(F.col("units") > 0, F.col("cost") / F.col("units") / SCALE)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), F.col("lang"), *_BASE, mean.alias("log_perplexity"))


def quality_rules(docs: DataFrame, band: float = BAND) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity of every row.

    base_failed: under 50 words, or over half of the words in 3-word windows that repeat. kept: not base_failed, and
    the perplexity within the band of the document's language. A null text has no words and fails; a null lang is a
    language of its own; repeated rows are rows each; an empty table gives none.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(scored(docs.select("doc_id", "lang", "text")).withColumn("base_failed", failed), "perplexity")
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bands = rows.filter(~F.col("base_failed")).groupBy("lang").agg(quartiles.alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD)) * band
    bands = bands.select("lang", (F.col("q")[0] - spread).alias("low"), (F.col("q")[1] + spread).alias("high"))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    joined = rows.join(F.broadcast(bands), "lang", "left")  # a row for each language
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), F.exp("log_perplexity").alias("perplexity"), "lang")
