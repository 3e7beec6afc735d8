import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logframe.llm import best_fit as B
from logframe.llm import token_blocks as T
from logframe.llm.token_counts import token_counts
from logframe.llm.tokens import PieceEncoder, tokenizer_path
from tests.llm.cases import empty, hostile, hostile_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return PieceEncoder(tokenizer_path(), max_pieces=50)


def library(coder, text):
    ids = coder.whole.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(coder, rows):
    return [(d, library(coder, t) + b"\x01\0\0\0") for d, t in rows]


def test_every_character_is_encoded_as_by_the_library(coder):
    for i in [*range(0x600), *range(0x1E00, 0x2100), 0x3000, 0xFEFF, 0x1F600]:
        for text in (chr(i), f"a{chr(i)}b", f"x{chr(i)} {chr(i)}'s 1{chr(i)}"):
            assert coder.encode(text) == library(coder, text), hex(i)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcXYZ '.s,!19 \n\t\x1c\xa0éßİΣ́漢") , max_size=40) | st.text(max_size=20))
def test_any_text_is_encoded_as_by_the_library(text):
    own = test_any_text_is_encoded_as_by_the_library.__dict__.setdefault("coder", PieceEncoder(tokenizer_path(), max_pieces=30))
    assert own.encode(text) == library(own, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3000), max_size=1200), st.integers(0, 1200), st.integers(0, 400))
def test_blocks_give_back_their_ids(ids, start, length):
    ids = np.array(ids, np.uint32)
    payload, starts = T.encode_blocks(ids)
    assert (T.decode_blocks(payload, starts) == ids).all()
    start = min(start, len(ids))
    length = min(length, len(ids) - start)
    assert (T.read_ids(payload, starts, start, length) == ids[start : start + length]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 5, np.uint32)
    small = len(T.encode_blocks(ids)[0])
    ids[7] = 2**31
    assert len(T.encode_blocks(ids)[0]) == small + 6


def test_checksums_combine():
    a, b = random.Random(1).randbytes(999), random.Random(2).randbytes(12345)
    assert T.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected_blocks(coder, rows):
    out, start = [], 0
    for d, raw in sorted(plain(coder, rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


def test_documents_come_back_from_files(spark, coder, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, T.token_blocks(documents).collect()))
    assert got == expected_blocks(coder, rows)


def test_hostile_documents_come_back(spark, coder):
    got = [tuple(r) for r in T.token_blocks(hostile(spark)).collect()]
    rows = [(r[0], r[1]) for r in hostile_rows()]
    raw = plain(coder, rows)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(x) // 4, zlib.crc32(x)) for d, x in raw)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == [d for d, *_ in sorted(got, key=key)]
    assert T.token_blocks(empty(spark)).count() == 0


def test_a_document_spans_segments(spark, coder, tmp_path):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, "c")], "doc_id long, text string")
    T.write_token_blocks(docs, str(tmp_path / "blocks"))
    assert T.read_segments(spark, str(tmp_path / "blocks")).count() > 2
    got = sorted(map(tuple, T.read_documents(spark, str(tmp_path / "blocks")).collect()))
    assert got == expected_blocks(coder, [(1, "a b"), (2, long), (3, "c")])


def check_packing(rows, raw, capacity):
    pieces = Counter()
    for d, x in raw:
        for k, at in enumerate(range(0, len(x), 4 * capacity)):
            part = x[at : at + 4 * capacity]
            pieces[d, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_whole_and_tight(spark, coder, documents, capacity, monkeypatch):
    monkeypatch.setattr(B, "PARTITION", 60)  # several partitions and rounds
    rows = B.best_fit_packing(documents, capacity).collect()
    raw = plain(coder, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    used = check_packing(rows, raw, capacity)
    lengths = Counter(r.length for r in rows)
    bound = B.lower_bound(np.array(list(lengths)), np.array(list(lengths.values())), capacity)
    assert bound <= used <= bound * 1.02 + 1


def test_hostile_documents_are_packed(spark, coder):
    raw = plain(coder, [(r[0], r[1]) for r in hostile_rows()])
    check_packing(B.best_fit_packing(hostile(spark)).collect(), raw, 4096)
    assert B.best_fit_packing(empty(spark)).count() == 0


def test_packed_ids_are_the_documents_ids(spark, coder, documents):
    placed = B.best_fit_packing(documents)
    whole = {r.sequence_id: r.ids for r in B.sequences(documents, placed).collect()}
    for r in placed.collect():
        part = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_no_packing_beats_the_lower_bound(lengths):
    def best(rest, bins):
        if not rest:
            return len(bins)
        options = {b: i for i, b in enumerate(bins) if b >= rest[0]}
        found = best(rest[1:], [*bins, 20 - rest[0]])
        for b, i in options.items():
            found = min(found, best(rest[1:], [*bins[:i], b - rest[0], *bins[i + 1 :]]))
        return found

    counts = Counter(lengths)
    bound = B.lower_bound(np.array(list(counts)), np.array(list(counts.values())), 20)
    assert bound <= best(sorted(lengths, reverse=True), [])


def test_counts(spark, coder, documents):
    want = {r.doc_id: (len((r.text or "").encode()), len(library(coder, r.text)) // 4) for r in documents.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(documents).collect()}
    assert got == want


def test_hostile_counts(spark, coder):
    got = Counter(map(tuple, token_counts(hostile(spark)).collect()))
    want = Counter()
    for d, t, *_ in hostile_rows():
        n = len(library(coder, t)) // 4
        want[d, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts(empty(spark)).count() == 0


def test_only_new_pieces_are_looked_up_again():
    class Counted(dict):
        read = []

        def __getitem__(self, key):
            self.read.append(key)
            return super().__getitem__(key)

    from logframe.llm.tokens import PieceEncoder, tokenizer_path

    coder = PieceEncoder(tokenizer_path())
    before = coder.encode("one two three")
    coder.known = Counted(coder.known)
    assert coder.encode("one two three zyxwv").startswith(before) and Counted.read == ["zyxwv"]
