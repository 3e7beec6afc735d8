"""Alignment of two tokenizers' tokens over the bytes of a text.

Both sides cut the bytes of " " + text, so a token is a run of bytes. Within a batch, keyed by document, an as-of merge
gives each token the other side's token that covers its first byte; both directions together are all pairs of tokens
that overlap. Where tokens of both sides end at one byte, a group ends.

Neither tokenizer joins anything across a single space between plain characters (side A starts a pre-token there, and no
piece of side B has a space mark behind another character), so a worker encodes each such segment once and keeps its
tokens in a bounded cache. Texts are read and encoded in one pass, which counts pairs of ids as well and writes the ids
of every document; the second pass reads those.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import unused, work_path, written
from logframe.llm.tokens import tokenizer_path

SIDE_A = "byte_bpe_50k.json"
SIDE_B = "piece_bpe_32k.model"
#: Pairs of ids whose counts every worker holds, the most frequent ones: 16 bytes each. The others are joined.
TABLE_PAIRS = 1 << 21
#: Bytes of text that are aligned at a time; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: A worker's cache starts anew beyond so many tokens of a side.
CACHE_TOKENS = 3 << 19

_PLAIN = "!-~\xa1-\xac\xae-ɏ"
_CUT = re.compile(f" (?<=[{_PLAIN}] )(?=[{_PLAIN}])")
_ENDS = re.compile(f"[{_PLAIN}](?:.*[{_PLAIN}])?\\Z", re.S)

_LETTERS, _DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Side A's pre-tokens in a text of plain characters.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^ {_LETTERS}{_DIGITS}]+")
_PLAIN_TEXT = re.compile(f"[{_PLAIN}]+\\Z")
#: A worker's cache of pre-tokens starts anew beyond so many.
_CACHE_WORDS = 250_000


def segments(text: str) -> list[str]:
    """Pieces of a text between single spaces that stand between plain characters."""
    return _CUT.split(text)


def _byte_of_letter() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


class _Rows:
    """A numpy array that grows."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(need, self.size), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


class _Side:
    """One tokenizer: ids of segments, and the bytes of each id."""

    exact = False

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = [self._piece(model, i) for i in range(model.get_piece_size())]
            if any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(len(self.bytes))):
                raise ValueError(f"{path} has pieces that reach over a space")
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            vocab, letters = whole.get_vocab(with_added_tokens=False), _byte_of_letter()
            self.bytes = [b""] * (max(whole.get_vocab().values()) + 1)
            for token, i in vocab.items():
                known = all(c in letters for c in token)
                self.bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
            self.words: dict[str, list[int]] = {}
            self.encode = lambda texts: self._by_words(whole, texts)
            # Without a normalizer and with a letter for every byte the ids give back any text.
            self.exact = whole.normalizer is None and set(letters) <= set(vocab)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def _by_words(self, whole, texts: list[str]) -> list[list[int]]:
        """The ids of " " + each text. The pre-tokens of plain texts are known from one pattern, and encoded once."""
        cut = [_WORDS.findall(" " + t) if _PLAIN_TEXT.match(t) else None for t in texts]
        if len(self.words) > _CACHE_WORDS:
            self.words = {}
        new = list({w: None for c in cut if c for w in c if w not in self.words})
        spaced = [w[1:] for w in new if w[0] == " "]
        self.words.update(zip([" " + w for w in spaced], self._in_runs(whole, spaced)))
        bare = [w for w in new if w[0] != " "]
        self.words.update(zip(bare, (e.ids for e in whole.encode_batch_fast(bare, add_special_tokens=False))))
        others = iter(self._in_runs(whole, [t for t, c in zip(texts, cut) if c is None]))
        words = self.words
        return [next(others) if c is None else words[c[0]] if len(c) == 1 else [i for w in c for i in words[w]] for c in cut]

    def _in_runs(self, whole, texts: list[str]) -> list[list[int]]:
        """The ids of " " + each text. Many texts with plain ends are one call's text, cut by the bytes of its tokens."""
        runs = [texts[i : i + 1000] for i in range(0, len(texts), 1000)]
        out: list[list[int]] = []
        for run, found in zip(runs, whole.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)):
            ids = found.ids
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(t.encode()) + 1 for t in run])
            at = np.searchsorted(ends, wanted)
            if all(map(_ENDS.match, run)) and len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                cuts = (at + 1).tolist()
                out += [ids[lo:hi] for lo, hi in zip([0, *cuts], cuts)]
            else:
                out += [e.ids for e in whole.encode_batch_fast([" " + t for t in run], add_special_tokens=False)]
        return out

    def wrong(self, texts: list[str], lists: list[list[int]], ids: np.ndarray) -> list[int]:
        """Places of the texts of which the ids give other bytes than " " + text."""
        if self.exact:
            return []
        want = [b" " + t.encode() for t in texts]
        ends = np.cumsum([len(x) for x in lists])
        lengths = np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends]
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) == b"".join(want) and (lengths == np.cumsum([len(w) for w in want])).all():
            return []
        return [at for at, (w, x) in enumerate(zip(want, lists)) if b"".join(map(self.bytes.__getitem__, x)) != w]

    @staticmethod
    def _piece(model, i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


class Tokens:
    """Tokens of both sides for segments. Beyond ``cache_tokens`` of a side those that came once are forgotten, or all."""

    def __init__(self, path_a: str, path_b: str, cache_tokens: int = CACHE_TOKENS):
        self.sides, self.cache_tokens = _sides(path_a, path_b), cache_tokens
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Forget all segments but those with the numbers to keep."""
        kept = [] if keep is None else [self.gather(side, keep) for side in (0, 1)]
        texts = [] if keep is None else list(map(list(self.known).__getitem__, keep.tolist()))
        wrong = set() if keep is None else self.wrong
        #: Segments of which a side gives other bytes than the text has.
        self.wrong = {new for new, old in enumerate([] if keep is None else keep.tolist()) if old in wrong}
        self.known: dict[str, int] = dict(zip(texts, range(len(texts))))
        self.ids = (_Rows(np.int32), _Rows(np.int32))
        self.ends = (_Rows(np.int64), _Rows(np.int64))
        self.seen = np.zeros(len(texts), np.int64)
        for (ids, counts), own, ends in zip(kept, self.ids, self.ends):
            own.add(ids)
            ends.add(np.cumsum(counts))

    def _make_room(self) -> None:
        if max(rows.size for rows in self.ids) > self.cache_tokens:
            keep = np.flatnonzero(self.seen > 1)
            few = max(self.gather(side, keep)[1].sum() for side in (0, 1)) <= self.cache_tokens // 2
            self.forget(keep if few else None)

    def find(self, found: list[str]) -> np.ndarray:
        """Numbers of segments; unknown ones are encoded in one call for each side."""
        numbers = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
        if (numbers < 0).any():
            self._make_room()
            new = list(dict.fromkeys(s for s in found if s not in self.known))
            first = len(self.known)
            both = [side.encode(new) for side in self.sides]
            for side, lists, ids, ends in zip(self.sides, both, self.ids, self.ends):
                flat = np.fromiter(chain.from_iterable(lists), np.int32)
                ends.add(ids.size + np.cumsum([len(x) for x in lists]))
                ids.add(flat)
                self.wrong.update(first + at for at in side.wrong(new, lists, flat))
            self.known.update(zip(new, range(first, first + len(new))))
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            numbers = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        self.seen += np.bincount(numbers, minlength=len(self.seen))
        return numbers

    def bytes_of(self, side: int, number: int) -> bytes:
        ends, ids = self.ends[side].data, self.ids[side].data
        return b"".join(map(self.sides[side].bytes.__getitem__, ids[ends[number - 1] if number else 0 : ends[number]]))

    def whole(self, text: str, numbers: np.ndarray) -> bool:
        """Whether both sides give back the bytes of a text."""
        if not any(n in self.wrong for n in numbers.tolist()):
            return True
        want = b" " + text.encode()
        return all(b"".join(self.bytes_of(s, n) for n in numbers.tolist()) == want for s in (0, 1))

    def gather(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments one after the other, and how many each has."""
        ends = self.ends[side].data
        first = np.where(numbers > 0, ends[numbers - 1], 0)
        counts = ends[numbers] - first
        shift = first - (np.cumsum(counts) - counts)
        return self.ids[side].data[np.repeat(shift, counts) + np.arange(counts.sum())], counts


_TOKENS: dict[tuple[str, str], Tokens] = {}


@lru_cache(4)
def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side]:
    return _Side(path_a), _Side(path_b)


def _tokens(path_a: str, path_b: str) -> Tokens:
    if (path_a, path_b) not in _TOKENS:
        _TOKENS[path_a, path_b] = Tokens(path_a, path_b)
    return _TOKENS[path_a, path_b]


class Aligned:
    """The tokens of some documents, aligned, from each side's ids and the document of each id. Both sides cut the same
    bytes, so places count through all documents."""

    def __init__(self, sides: tuple[_Side, _Side], ids: list[np.ndarray], doc: list[np.ndarray], n_docs: int):
        self.n_docs, self.ids, self.doc, self.start = n_docs, ids, doc, []
        for side, own in zip(sides, ids):
            lengths = side.lengths[own]
            self.start.append(np.cumsum(lengths) - lengths)
        covering_a, covering_b = self._covering(0), self._covering(1)
        # Tokens that start at one byte start a group: the other side's token before it ends there as well.
        opens = [self.start[1][covering_a] == self.start[0], self.start[0][covering_b] == self.start[1]]
        # A pair that both directions find has one first byte; it counts once.
        more = np.flatnonzero(~opens[1])
        a = np.concatenate([np.arange(len(covering_a)), covering_b[more]])
        b = np.concatenate([covering_a, more])
        self.link_a, self.link_b, self.link_doc = self.ids[0][a], self.ids[1][b], self.doc[0][a]
        self.group = [np.cumsum(o) - 1 for o in opens]
        self.closes = [np.append(o[1:], True) for o in opens]
        self.n_groups = np.bincount(self.doc[0][opens[0]], minlength=n_docs)

    def _covering(self, side: int) -> np.ndarray:
        """For each token of a side the place of the other side's token that holds its first byte."""
        left = pd.DataFrame({"start": self.start[side], "doc": self.doc[side]})
        right = pd.DataFrame({"start": self.start[1 - side], "doc": self.doc[1 - side], "place": np.arange(len(self.ids[1 - side]))})
        return pd.merge_asof(left, right, on="start", by="doc")["place"].to_numpy(np.int64)

    def count(self, side: int) -> np.ndarray:
        return np.bincount(self.doc[side], minlength=self.n_docs)


class _Digits:
    """The decimal digits of each id with the mark that follows it in a list of groups: inside a side, or at its end."""

    def __init__(self, sides: tuple[_Side, _Side]):
        sizes = [len(side.bytes) for side in sides]
        self.of = [np.array([f"{i}{m}" for i in range(n) for m in marks], object) for n, marks in zip(sizes, (",|", ",;"))]

    def texts(self, aligned: Aligned) -> list[str]:
        """The groups of each document, a1,a2|b1;a3|b2,b3."""
        a, b = (np.bincount(g) for g in aligned.group)
        before = [(np.cumsum(b) - b)[aligned.group[0]], np.cumsum(a)[aligned.group[1]]]  # of the other side
        out = np.empty(len(before[0]) + len(before[1]), object)
        for side in (0, 1):
            out[np.arange(len(before[side])) + before[side]] = self.of[side][2 * aligned.ids[side] + aligned.closes[side]]
        ends = np.cumsum(aligned.count(0) + aligned.count(1)).tolist()
        return ["".join(out[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends], ends)]


def _documents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of so many bytes of text (the last column), null as the empty text."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        first = held = 0
        for at, text in enumerate(texts):
            if held and held + len(text) > size:
                yield batch.slice(first, at - first), texts[first:at]
                first, held = at, 0
            held += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def _segmented(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the segments of all texts that both sides give back, and the text of each."""
    cut = [segments(t) if t else [] for t in texts]
    numbers = tokens.find([s for c in cut for s in c])
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    if tokens.wrong:
        ends = np.cumsum([len(c) for c in cut]).tolist()
        whole = np.array([tokens.whole(t, numbers[lo:hi]) for t, lo, hi in zip(texts, [0, *ends], ends)], bool)
        kept = whole[doc] if len(doc) else np.empty(0, bool)
        numbers, doc = numbers[kept], doc[kept]
    return numbers, doc


def _pair(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    return a.astype(np.int64) * width + b


def _id_type(side: _Side) -> type:
    return np.uint16 if len(side.bytes) <= 1 << 16 else np.int32


def _encoded(paths: tuple[str, str], schema: pa.Schema):
    """Rows of two kinds: every row with its ids in place of the text, and links of each pair of ids in a run of rows.

    Equal segments are aligned once and count as often as they occur.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(*paths)
        width = len(tokens.sides[1].bytes)
        for rows, texts in _documents(batches, BATCH_BYTES):
            numbers, doc = _segmented(tokens, texts)
            kept = [rows.column(i) for i in range(rows.num_columns - 1)]
            ids = []
            for side in (0, 1):
                own, counts = tokens.gather(side, numbers)
                size = np.bincount(doc, weights=counts, minlength=len(texts)).astype(np.int64)
                raw, cuts = own.astype(_id_type(tokens.sides[side])), np.cumsum(size).tolist()
                ids.append(pa.array([raw[lo:hi].tobytes() for lo, hi in zip([0, *cuts], cuts)], pa.binary()))
            none = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *ids, *none], schema=schema)
            if len(numbers):
                once, times = np.unique(numbers, return_counts=True)
                both = [tokens.gather(side, once) for side in (0, 1)]
                found = Aligned(tokens.sides, [x for x, _ in both], [np.repeat(np.arange(len(once)), n) for _, n in both], len(once))
                pairs, at = np.unique(_pair(found.link_a, found.link_b, width), return_inverse=True)
                links = np.bincount(at, weights=times[found.link_doc]).astype(np.int64)
                counts = [pa.array(pairs), pa.array((pairs % width).astype(np.int32)), pa.array(links)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), f.type) for f in list(schema)[:-3]), *counts], schema=schema)

    return encode


def _id_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of so many bytes of ids (the last two columns)."""
    for batch in batches:
        held, first = 0, 0
        sizes = [pc.binary_length(batch.column(batch.num_columns - i)).to_numpy(zero_copy_only=False) for i in (1, 2)]
        for at, n in enumerate((sizes[0] + sizes[1]).tolist()):
            if held and held + n > size:
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


_FACTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, pairs array<long>, times array<long>"


def _facts(paths: tuple[str, str], table, schema: pa.Schema, with_groups: str):
    """Counts of each document by the table of frequent pairs, and the pairs that it lacks with how often they occur."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*paths)
        width, digits = len(sides[1].bytes), _Digits(sides)
        keys, links, best = table.value
        frequent = pd.Index(keys)
        for rows in _id_runs(batches, BATCH_BYTES):
            n, ids, doc = rows.num_rows, [], []
            for i, side in enumerate(sides):
                raw = rows.column(rows.num_columns - 2 + i).to_pylist()
                ids.append(np.frombuffer(b"".join(raw), _id_type(side)).astype(np.int32))
                doc.append(np.repeat(np.arange(n), [len(x) // _id_type(side)().itemsize for x in raw]))
            n_a = n_b = n_groups = n_links = n_best = total = np.zeros(n, np.int64)
            groups, rest, times, rest_of = [""] * n, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
            if len(ids[0]):
                found = Aligned(sides, ids, doc, n)
                n_groups, n_links = found.n_groups, np.bincount(found.link_doc, minlength=n)
                n_a, n_b, groups = found.count(0), found.count(1), digits.texts(found)
                if with_groups == "sha256":
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                pairs = _pair(found.link_a, found.link_b, width)
                at = frequent.get_indexer(pairs)
                held = at >= 0
                where, at = found.link_doc[held], at[held]
                total = np.zeros(n, np.int64)
                np.add.at(total, where, links[at])
                n_best = np.bincount(where[best[at]], minlength=n)
                if not held.all():
                    both = np.stack([found.link_doc[~held], pairs[~held]])
                    both, times = np.unique(both, axis=1, return_counts=True)
                    rest, rest_of = both[1], np.bincount(both[0], minlength=n)
            ends = pa.array(np.concatenate([[0], np.cumsum(rest_of)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (rest, times)]
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links, n_best, total)]
            kept = [rows.column(i) for i in range(rows.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array(groups, pa.string()), *lists], schema=schema)

    return facts


def _pair_counts(found: DataFrame) -> DataFrame:
    """Links of each pair of ids over all texts, and whether no other pair of its B id has more; ties are best alike.

    Columns pair (the A id times the size of side B, plus the B id), links, best.
    """
    pairs = written(found.groupBy("pair").agg(F.first("b").alias("b"), F.sum("links").alias("links")), "pairs")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))  # a row for each B id
    return pairs.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[int | None, DataFrame]:
    """The pairs whose links reach a power of two, as low a one as lets at most ``limit`` of them through; the power, or
    None where all pairs pass."""
    power = F.floor(F.log2("links")).cast("int")
    sizes = {r.power: r.n for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    held, least = 0, 64
    for p in sorted(sizes, reverse=True):
        if held + sizes[p] > limit:
            return 1 << min(least, 62), counts.filter(F.col("links") >= (1 << min(least, 62)))
        held, least = held + sizes[p], p
    return None, counts


def align_tokens(
    docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, *, keep: tuple[str, ...] = ("doc_id",),
    groups: str = "text", table_pairs: int = TABLE_PAIRS,
) -> DataFrame:
    """Each document's tokens of side A (a byte-level vocabulary, over " " + text) and B (pieces, over text), aligned.

    Returns the ``keep`` columns with n_a and n_b (tokens), n_groups, n_links (pairs of tokens whose bytes overlap),
    count_sum (over the links: how many links of the corpus join the same two ids), n_best (links whose ids are joined as
    often as the B id is joined to any A id; ties count) and groups: their ids as ``a1,a2|b1;a3|b2,b3``, or the lower-case
    sha256 of that with ``groups="sha256"``.

    The counts of the ``table_pairs`` most frequent pairs go to every worker (16 bytes a pair); rarer ones are joined in a
    shuffle, so no frequent pair is a key there. Texts are read and encoded once and never moved; the ids of all
    documents, about as large as the texts, are written to the shared folder for the second pass.

    Null and empty texts, and texts that a side does not give back byte by byte, have no tokens: zeros and an empty string.
    A very long text is one batch and is never cut. Repeated rows are rows of their own and all count; a null or repeated
    doc_id is a value like any other. Other columns of any name are left alone. An empty table gives an empty table.
    """
    spark, paths = docs.sparkSession, (tokenizer_path(side_a), tokenizer_path(side_b))
    source = docs.select(*keep, "text")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    inner = [unused(n, source) for n in ("ids_a", "ids_b", "pair", "b", "links")]
    types = ("binary", "binary", "long", "int", "long")
    both = spark.createDataFrame([], kept + ", ".join(f"{n} {t}" for n, t in zip(inner, types))).schema
    encoded = written(source.mapInArrow(_encoded(paths, _arrow(both)), both), "token-ids")
    found = encoded.filter(F.col(inner[2]).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(inner[2:], ("pair", "b", "links"))))
    counts = written(_pair_counts(found), "pair-counts")
    least, table = _frequent(counts, table_pairs)
    held = table.toPandas().sort_values("pair")
    arrays = (held["pair"].to_numpy(np.int64), held["links"].to_numpy(np.int64), held["best"].to_numpy(bool))
    out = spark.createDataFrame([], kept + _FACTS).schema
    rows = encoded.filter(F.col(inner[2]).isNull()).select(*keep, *inner[:2])
    facts = rows.mapInArrow(_facts(paths, spark.sparkContext.broadcast(arrays), _arrow(out), groups), out)
    if least is None:
        return facts.drop("pairs", "times")
    return _with_rare(facts, counts.filter(F.col("links") < least), out)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _with_rare(facts: DataFrame, rare: DataFrame, schema) -> DataFrame:
    """The facts with what the rare pairs add; rows are told apart by a number that the written table fixes."""
    row, more, better = unused("row", facts), unused("more", facts), unused("better", facts)
    rows = written(facts.withColumn(row, F.monotonically_increasing_id()), "aligned")
    own = rows.select(row, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    found = own.join(rare, "pair").groupBy(row).agg(
        F.sum(F.col("links") * F.col("times")).alias(more), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias(better)
    )

    def plus(name: str, other: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(other), F.lit(0))).alias(name)

    added = {"count_sum": plus("count_sum", more), "n_best": plus("n_best", better)}
    wanted = [added.get(n, F.col(f"`{n}`")) for n in schema.names if n not in ("pairs", "times")]
    return rows.join(found, row, "left").select(*wanted)
