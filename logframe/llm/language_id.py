"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3 letters, words bounded by a blank), most frequent
first. A document goes to the language whose profile is nearest by out-of-place distance: the sum, over the document's
n-grams, of how far each stands from its place in the language's profile, or the profile's length if it is not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
PROFILE = 400
#: Profiles are broadcast; with more languages than this, training raises an error. 400 n-grams each: under 32 MB.
MAX_LANGUAGES = 1_000
#: The prediction for a text without letters.
UNKNOWN = "und"
#: Characters that are cut into n-grams at once.
CHUNK = 1_000_000

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Every n-gram of the letters of a text as one number; empty for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if len(codes) < 3:
        return np.empty(0, np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    a, b, c = a[inner], b[inner], c[inner]
    one = b << np.uint64(42)
    pairs = np.concatenate([b << np.uint64(21) | c, (b << np.uint64(0))[a == 0]]) | np.uint64(1 << 63)
    three = a << np.uint64(42) | b << np.uint64(21) | c
    return np.concatenate([one, pairs, three])


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first)


def top(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, by count and then by number."""
    distinct, counts = _counted(keys)
    return distinct[np.argsort(-counts, kind="stable")[:most]]


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts: dict[str, list[str]] = {}
    size: dict[str, int] = {}

    def fold(lang: str, least: int) -> None:
        parts = held.get(lang, [])
        if len(parts) > least:
            held[lang] = [_counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]

    def flush(lang: str) -> None:
        held.setdefault(lang, []).append(_counted(ngrams(" ".join(texts.pop(lang)))))
        size[lang] = 0
        fold(lang, 8)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                flush(lang)
    for lang in list(texts):
        flush(lang)
    for lang in held:
        fold(lang, 1)
        keys, counts = held[lang][0]
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            columns = [pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[at : at + 50_000])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "ngram", "n"])


def learn_profiles(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language of all rows with lang and text: n-grams counted in every task, summed, ranked.

    Ranking keeps the first of each task before it shuffles, so a language that has most rows is no hot key.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    counts = rows.mapInArrow(_count_languages, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    ranked = counts.withColumn("place", place).filter(F.col("place") <= profile)
    found: dict[str, list] = {}
    for lang, ngram, at in ranked.select("lang", "ngram", "place").orderBy("lang", "place").limit(profile * MAX_LANGUAGES + 1).toLocalIterator():
        found.setdefault(lang, []).append(ngram)
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {lang: np.array(keys, np.int64).view(np.uint64) for lang, keys in found.items()}


class Profiles:
    """All languages' places of all n-grams that any profile has."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = PROFILE):
        self.languages = sorted(profiles)
        self.length = length
        self.keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        # the last row stands for an n-gram that no profile has
        self.places = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int32)
        for i, lang in enumerate(self.languages):
            self.places[np.searchsorted(self.keys, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Distance to each language, and the largest that there is for this text (0: no letters)."""
        own = top(ngrams(text), self.length)
        if not len(own) or not self.languages:
            return np.zeros(len(self.languages)), 0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        places = self.places[at]
        apart = np.where(places < 0, self.length, np.minimum(np.abs(places - np.arange(len(own))[:, None]), self.length))
        return apart.sum(axis=0), len(own) * self.length

    def predict(self, text: str | None) -> tuple[str, float]:
        apart, most = self.distances(text) if text else (None, 0)
        if not most:
            return UNKNOWN, 0.0
        order = np.argsort(apart, kind="stable")
        near = 1 - apart[order[0]] / most
        next_near = 1 - apart[order[1]] / most if len(order) > 1 else 0.0
        return self.languages[order[0]], float(near / (near + next_near)) if near > 0 else 0.0


def held_out(doc_id: Column) -> Column:
    """Documents that no profile learns from: crc32 of the id's text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), profile: int = PROFILE, told: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns with lang_pred and score, for every row; ``und`` and 0 for a text that is null or has no letter.

    ``told`` gives these two other names, for tables that keep columns of theirs.

    score is the nearest language's likeness (1 less its distance as a share of the largest) as a share of the two
    nearest languages' likeness. Equal distances go to the language that comes first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, profile))
    names = [f"kept{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            found = [known.predict(t) for t in b.column(len(names)).to_pylist()]
            columns = [b.column(i) for i in range(len(names))]
            columns += [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "lang_pred string", "score double"])
    out = source.mapInArrow(predict, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *(F.col(c).alias(n) for c, n in zip(("lang_pred", "score"), told)))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out.

    lang, source and doc_id decide only what is learned from, never a prediction. Repeated rows give repeated rows, an
    empty table none; without anything to learn from, every document is ``und``.
    """
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    out = predict_languages(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
