import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logframe.llm import line_dedup as L
from logframe.llm import token_align as T
from logframe.llm import whiten as W
from logframe.llm.tokens import tokenizer_path
from tests.llm.cases import empty, hostile, hostile_rows

SF = "/root/testdata/sf0.001"


# Lines


def plain_lines(rows):
    """(doc_id, n_lines, n_dropped, kept) of each row (doc_id, text), by a dict of the first holder of each key."""

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= 10 else None

    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in sorted(rows, key=lambda r: order(r[0])):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), d)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or first[key(x)] == d]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def deduped(docs, **options):
    return Counter(map(tuple, L.dedup_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "copy_lines": 50}, {"shard_lines": 3}])
def test_lines_of_documents(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_lines(rows)
    assert sum(n for (_, _, dropped, _), n in want.items() if dropped) > 10
    assert deduped(docs, **options) == want


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "copy_lines": 2}])
def test_lines_of_hostile_documents(spark, options):
    rows = [(r[0], r[1]) for r in hostile_rows()]
    rows += [(i, f"A line that a third of all has\n own line {i} of it\r\n\ta LINE that a third of all has ") for i in range(40, 80)]
    docs = hostile(spark).select("doc_id", "text", "row_no", "key").unionByName(
        spark.createDataFrame(rows[len(hostile_rows()) :], "doc_id long, text string"), allowMissingColumns=True
    ).withColumns({c: L.F.lit("clash") for c in ("row", "suspects", "digest", "digests", "n_lines", "kept_text", "shard", "copy", "bits", "first", "lines")})
    assert deduped(docs, **options) == plain_lines(rows)
    assert L.dedup_lines(empty(spark), **options).count() == 0


def test_other_columns_can_be_kept(spark):
    docs = spark.createDataFrame([(2, "the same line here", "x"), (1, "The same LINE here ", "y"), (3, "short", "z")], "doc_id long, text string, row string")
    got = {tuple(r) for r in L.dedup_lines(docs, keep=("doc_id", "row")).collect()}
    assert got == {(2, "x", 1, "", 1), (1, "y", 1, "The same LINE here ", 0), (3, "z", 1, "short", 0)}


def test_twice_seen_filter_holds_every_repeat_and_little_else(spark):
    rng = random.Random(3)
    many = [f"line number {rng.random()}" for _ in range(30_000)]
    rows = [(i, "\n".join(many[10 * i : 10 * i + 12])) for i in range(3000)]  # two lines of each go on in the next
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    shape = L._Shape(36_000, 1000)
    bits = np.zeros((shape.shards, shape.bits // 8), np.uint8)
    for r in L.twice_filter(docs, shape).collect():
        bits[r.shard] = np.frombuffer(r.bits, np.uint8)

    def held(lines):
        hashes = L._hashes([L.line_key(x) for x in lines])
        places = shape.places(hashes)
        return ((bits[shape.shard(hashes)[:, None], places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)

    seen = Counter(x for _, t in rows for x in t.split("\n"))
    assert held([x for x, n in seen.items() if n > 1]).all()
    assert held([x for x, n in seen.items() if n == 1]).mean() < 0.03


# Vectors


def plain_whitening(vectors):
    """x of each usable vector, and n, S, V over the distinct ones."""
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    return x, n, s, centred.T @ centred / n


def check_whitening(rows, vectors, components=4):
    x, n, s, v = plain_whitening(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r.vec_id][r.component] = r
    assert set(by_id) == set(x) and all(set(c) == set(range(1, components + 1)) for c in by_id.values())
    for k in range(components):
        signs = set()
        for i, found in by_id.items():
            r = found[k + 1]
            want = (x[i] - s / n) @ axes[:, k] / np.sqrt(values[k])
            assert abs(abs(r.whitened) - abs(want)) < 1e-6
            if abs(want) > 1e-3:
                signs.add(r.whitened * want > 0)
            assert r.n == n and int(r.deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
            assert abs(r.explained - values[k] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9
        assert len(signs) == 1


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.collect()]
    found, fitted = W.whiten(table)
    check_whitening(found.collect(), vectors)
    assert fitted.projection.shape == (len(vectors[0][1]), 4)


def test_whitening_of_hostile_vectors(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 64)  # many blocks, several of columns
    monkeypatch.setattr(W, "BLOCK_COLUMNS", 4)
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(120)]
    good += [(i, good[3][1]) for i in range(120, 200)]  # a third of all rows
    good += [(200, good[4][1][:5] + [good[4][1][5] + 1e-9]), (201, [-0.0] * 6), (202, [1e3] + [0.0] * 5)]
    bad = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5),
           (305, [1e300] * 6), (306, [1.0, 2.0]), (307, [1.0] * 7)]
    rows = [(i, v, "a", "b", "c", "d") for i, v in good + bad]
    clash = "vec_id long, embedding array<double>, x string, digest string, index string, n string"
    table = spark.createDataFrame(rows, clash).repartition(5)
    check_whitening(W.whiten(table)[0].collect(), good)
    assert W.whiten(table.filter("vec_id >= 300 AND vec_id < 306"))[0].count() == 0
    assert W.whiten(table.filter("vec_id BETWEEN 120 AND 199"))[0].count() == 0  # one vector: no direction has variance
    assert W.whiten(table.limit(0))[0].collect() == []


def test_deviation_beyond_longs_is_exact(spark):
    vectors = [(1, [3e12, 1.0]), (2, [-3e12, 5.0]), (3, [7e12, 2.0]), (None, [1e12, 9.0]), (None, [1e12, 9.0])]
    found = W.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), components=1)[0].collect()
    x, n, s, _ = plain_whitening([(1, vectors[0][1]), (2, vectors[1][1]), (3, vectors[2][1]), (4, vectors[3][1])])
    got = {r.vec_id: int(r.deviation) for r in found if r.vec_id}
    assert len(found) == 5
    assert got == {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) for i in (1, 2, 3)}


# Tokens


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(tokenizer_path(T.SIDE_A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(T.SIDE_B))
    a.encode_special_tokens = True
    return a, b


def plain_tokens(sides, text):
    """(id, bytes) of both sides, or nothing where a side gives other bytes."""
    a, b = sides
    if not text:
        return [], []
    letters = T._byte_of_letter()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def plain_alignment(sides, rows):
    docs, total = [], Counter()
    for d, text in rows:
        spans = []
        for tokens in plain_tokens(sides, text):
            at, side = 0, []
            for i, raw in tokens:
                side.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(side)
        links = [(i, j) for i, a, z in spans[0] for j, b, y in spans[1] if a < y and b < z]
        ends = sorted({z for *_, z in spans[0]} & {z for *_, z in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, a, z in side if start <= a and z <= end) for side in spans))
            start = end
        docs.append((d, len(spans[0]), len(spans[1]), links, groups))
        total.update(links)
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return Counter(
        (d, a, b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), ";".join(groups))
        for d, a, b, links, groups in docs
    )


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("table_pairs", [T.TABLE_PAIRS, 200, 0])
def test_alignment_of_documents(spark, sides, table_pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 700 OR text IS NULL").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = T.align_tokens(docs, table_pairs=table_pairs).select(*NAMES).collect()
    assert Counter(map(tuple, got)) == plain_alignment(sides, rows)


@pytest.mark.parametrize("table_pairs", [T.TABLE_PAIRS, 5])
def test_alignment_of_hostile_documents(spark, sides, table_pairs):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 5000 else r[1][:5000]) for r in hostile_rows()]
    rows += [(50, " two  spaces ▁ mark"), (51, "▁"), (52, " "), (53, "▁x y"), (54, "ﬁ ligature ½ Å"), (55, "漢字 かな 한글 👩‍👩‍👧 é")]
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], "doc_id long, text string, row string, n_a string, pairs string, more string").repartition(3)
    got = T.align_tokens(docs, table_pairs=table_pairs).select(*NAMES).collect()
    assert Counter(map(tuple, got)) == plain_alignment(sides, rows)
    assert T.align_tokens(empty(spark), table_pairs=table_pairs).count() == 0


def test_long_texts_are_aligned_whole(spark, sides):
    text = next(r[1] for r in hostile_rows() if r[1] and len(r[1]) > 100_000)
    (found,) = T.align_tokens(spark.createDataFrame([(1, text), (2, "x" * 70_000)], "doc_id long, text string"), groups="sha256").filter("doc_id = 1").collect()
    a, b = plain_tokens(sides, text)
    assert (found.n_a, found.n_b) == (len(a), len(b)) and found.n_links == found.n_a + found.n_b - found.n_groups
    assert len(found.groups) == len(hashlib.sha256().hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcXYZ '.s,!19 \n\t\x1c\xa0éßİΣ́漢▁") , max_size=40) | st.text(max_size=20))
def test_segments_give_the_tokens_of_the_whole_text(sides, text):
    own = test_segments_give_the_tokens_of_the_whole_text.__dict__.setdefault(
        "own", T.Tokens(tokenizer_path(T.SIDE_A), tokenizer_path(T.SIDE_B), cache_tokens=300)
    )
    if text:
        numbers = own.find(T.segments(text))
        a, b = sides
        assert own.gather(0, numbers)[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert own.gather(1, numbers)[0].tolist() == b.encode(text)
        assert own.whole(text, numbers) == (plain_tokens(sides, text) != ([], []))
