"""Languages, perplexity, pages and archives against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import html_extract as H
from logframe.llm import language_id as G
from logframe.llm import perplexity as X
from logframe.llm import warc_archive as W
from tests.llm.cases import ascii_words, empty, hostile, hostile_rows

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, record_no string, host string, sha256 string"


# Languages


def plain_ngrams(text):
    words = re.split(r"\s+", "".join(c if c.isalpha() else " " for c in text.lower()).strip())
    out = Counter()
    for w in filter(None, words):
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != " ":
                    out[padded[i : i + n]] += 1
    return out


def test_ngrams_are_those_of_the_words():
    for text in ("Ab cab, ab!", "a", "é1É", "", "x  y\nz", "\U0001f600 \U00010400"):
        assert Counter(Counter(G.ngrams(text).tolist()).values()) == Counter(plain_ngrams(text).values())


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in G.language_id(docs).collect()}
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    out = [d for d, r in rows.items() if r.held_out and len(truth[d][1]) > 20]
    assert sum(rows[d].lang_pred == truth[d][0] for d in out) >= 0.97 * len(out)


def test_predictions_are_those_of_plain_profiles(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    data = docs.collect()
    counts = {}
    for r in data:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(plain_ngrams(r.text))

    def number(g):  # ties go by the number of the n-gram
        c = [0 if x == " " else ord(x) for x in g]
        return c[0] << 42 if len(c) == 1 else (1 << 63 | c[0] << 21 | c[1]) if len(c) == 2 else c[0] << 42 | c[1] << 21 | c[2]

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ranked = lambda c, key: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(number(x[0]))))][: G.PROFILE]
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, signed))} for lang, c in counts.items()}
    got = {r.doc_id: r.lang_pred for r in G.language_id(docs).collect()}
    for r in data:
        own = ranked(plain_ngrams(r.text), lambda x: x)
        far = {lang: sum(min(abs(p[g] - i), G.PROFILE) if g in p else G.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        assert got[r.doc_id] == min(sorted(far), key=far.get)


def test_hostile_languages(spark):
    rows = G.language_id(hostile(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in hostile_rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2, 11, 15))
    assert G.language_id(empty(spark)).count() == 0
    unlearned = G.language_id(hostile(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlearned) == len(rows) and all(r.lang_pred == "und" for r in unlearned)


# Quality


def plain_base(text):
    text = text or ""
    w = ascii_words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if ascii_words(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def check_base(rows, texts):
    want = Counter()
    for d, t in texts:
        base = plain_base(t)
        want[d, *base, base[0] < 50 or 100 * base[4] > 50 * base[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want


def test_base_columns_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = X.quality_rules(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert not any(r.kept and r.base_failed for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if quality.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good) and sum(bad) < sum(good) / len(good) * len(bad)


def test_hostile_base_columns(spark):
    check_base(X.quality_rules(hostile(spark)).collect(), [(r[0], r[1]) for r in hostile_rows()])
    assert X.quality_rules(empty(spark)).count() == 0


def test_repeated_windows_of_many_words():
    ids = np.array([3, 1, 2, 3, 1, 2, 9])
    assert len(np.unique(X._window_ids(ids))) == 4


def plain_kneser_ney(text):
    """Modified Kneser-Ney by dictionaries: probability of each counted n-gram."""
    counted = Counter(X.ngrams(text).tolist())
    levels = {X.ORDER: counted}
    for order in range(X.ORDER - 1, 0, -1):
        levels[order] = Counter(k % X.CLASSES**order for k in levels[order + 1])
    below = lambda k: 1 / X.CLASSES
    for order in range(1, X.ORDER + 1):
        c = levels[order]
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
        give = lambda v, y=y, n=n: 0.5 if y is None else min(min(v, 3), max(0.1, min(v, 3) - (min(v, 3) + 1) * y * n[min(v, 3)] / max(n[min(v, 3) - 1], 1)))
        total, rest = Counter(), Counter()
        for k, v in c.items():
            total[k // X.CLASSES] += v
            rest[k // X.CLASSES] += give(v)
        known = {k: (v - give(v)) / total[k // X.CLASSES] + rest[k // X.CLASSES] / total[k // X.CLASSES] * below(k % X.CLASSES ** (order - 1)) for k, v in c.items()}
        below = known.__getitem__
    return known


def test_model_is_that_of_plain_kneser_ney():
    text = " ".join(r[1] for r in hostile_rows()[5:8])
    keys, counts = np.unique(X.ngrams(text), return_counts=True)
    want = plain_kneser_ney(text)
    logs = X.kneser_ney(keys, counts)
    assert all(math.isclose(math.log(want[k]), v, abs_tol=1e-4) for k, v in zip(keys.tolist(), logs.tolist()))


def test_counts_are_those_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        for k in X.ngrams(r.text).tolist():
            want[r.lang, k] += 1
    assert {(r.lang, r.ngram): r.n for r in X.ngram_counts(docs).collect()} == want


def test_languages_in_several_groups(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    one = Counter(map(tuple, X.scored(docs).collect()))
    monkeypatch.setattr(X, "GROUP", 1)
    assert Counter(map(tuple, X.scored(docs).collect())) == one


def test_characters_are_not_folded(spark):
    """Letters, digits and signs that shared a class (the code point by three, one class of digits) have their own n-grams."""
    for a, b in (("1", "7"), ("é", "ì"), ("中", "丰"), ("\U0001f600", "\U0001f601"), ("(", ";")):
        assert set(X.ngrams(a).tolist()) != set(X.ngrams(b).tolist())
    docs = spark.createDataFrame([(i, "de", "tag é 1 (a) " * 30) for i in range(20)] + [(20, "de", "tag ì 7 ;a; " * 30)], "doc_id long, lang string, text string")
    logs = {r.doc_id: r.log_perplexity for r in X.scored(docs).collect()}
    assert logs[20] > logs[0] + 0.1


@pytest.mark.parametrize("broadcast", [0, 5, 10**6])
def test_spark_trains_and_scores_the_model_of_one_process(spark, monkeypatch, broadcast):
    texts = [r[1] or "" for r in hostile_rows()] + ["ünï 中文 \U0001f600\U00010400 " * 3]
    docs = spark.createDataFrame([(i, str(i % 2), t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    want = {}
    for lang in "01":
        keys, counts = np.unique(np.concatenate([X.ngrams(t) for t in texts[int(lang) :: 2]]), return_counts=True)
        want |= {(lang, k): v for k, v in zip(keys.view(np.int64).tolist(), X.kneser_ney(keys, counts).tolist())}
    got = {(r.lang, r.ngram): -r.cost / X.SCALE for r in X.train(X.ngram_counts(docs)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-4) for k in want)
    monkeypatch.setattr(X, "GROUP", broadcast)
    for r in X.scored(docs).collect():
        own = X.ngrams(texts[r.doc_id]).view(np.int64).tolist()
        mean = -sum(want[str(r.doc_id % 2), k] for k in own) / len(own) if own else None
        assert (r.log_perplexity is None) == (mean is None) and (mean is None or math.isclose(r.log_perplexity, mean, abs_tol=1e-3))


# Pages


def article(html):
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    inner = re.sub("</?b>", "", inner.replace("<br>", " "))
    blocks = (re.sub(r"\s+", " ", H.unescape(b)).strip() for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(filter(None, blocks))


@pytest.mark.parametrize("limit", [H.BROADCAST_BYTES, -1])
def test_articles(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in H.extract_text(pages).collect()} == want


def page(*blocks, before="", after=""):
    return f"<html><body><div class='top-menu'><a>Home</a></div>{before}<div id=c>{''.join(blocks)}</div>{after}</body></html>"


def test_wrappers_have_slots_options_and_repeats():
    pages = [page("<h2>A</h2>", "<p>one</p><p>two</p>"), page("<h2>B</h2>", "<p>three</p>", after="<div class=comments><p>hi</p></div>")]
    wrapper = H.infer(pages)
    kinds = Counter()

    def walk(nodes):
        for n in nodes:
            kinds[n[0]] += 1
            if n[0] in "or":
                walk(n[1])

    walk(wrapper)
    assert kinds["r"] >= 1 and kinds["o"] >= 1 and kinds["x"] >= 3
    assert H.main_text(pages[0], wrapper) == "A\none\ntwo"
    assert H.main_text(pages[1], wrapper) == "B\nthree"


def test_text_that_all_pages_of_a_host_share_is_no_main_text():
    pages = [page(f"<p>story {i} and its very own words</p>", "<div>Copyright of the house</div>") for i in range(5)]
    assert H.main_text(pages[2], H.infer(pages)) == "story 2 and its very own words"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>a &lt; b&nbsp;&amp; c<p>d<b>e</b> f<br>g</article><footer>x</footer>", "a < b & c\nde f g"),
        ("<nav>n</nav><article><h1>T</h1><form>f</form><script>var a='<p>';</script><p>x</p><!-- <p>c</p> --></article>", "T\nx"),
        ("<main><div class='ad'>buy</div><ul><li>1<li>2</ul><p>z</main>", "1\n2\nz"),
        ("<article class='comment'><p>me too</p></article><article><p>real</p></article>", "real"),
        ("just text", "just text"),
        ("<p", "<p"),
        ("<script>never closed <p>x</p>", ""),
        ("", ""),
    ],
)
def test_single_pages(html, text):
    assert H.main_text(html, H.infer([html])) == text
    assert H.main_text(html, None) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>a</p><svg class="i"/><p>b</p><p>c</p></article>', "a\nb\nc"),
        ("<article><p>a</p><video-player src=x></video-player><p>b</p></article>", "a\nb"),
        ("<article><p>a <svg><title>t</title><text>no</text></svg>b</p><p>c</p></article>", "a b\nc"),
        ("<article><p>a</p><select><option>no<p>b</p><p>c</p></article><p>d</p>", "a\nb\nc"),
        ("<article>x <video>b<p>c</p></article>", "x\nb\nc"),
        ("<article><p>a</p><svg><title/><style/></svg><noscript><p>no</p></noscript><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><script>'<p>no'</script ><textarea>no<p></textarea><p>b</p></article>", "a\nb"),
        ("<article><p>a<svg/>b</svg></p></article>", "ab"),
    ],
)
def test_embedded_elements_hide_their_own_content_only(html, text):
    assert H.main_text(html, H.infer([html])) == text
    assert H.main_text(html, None) == text


def texts_of(spark, htmls):
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)]
    found = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [found[i] for i in range(len(htmls))]


def test_elements_of_few_pages_of_a_host_stay(spark):
    pages = [page(f"<h2>T{i}</h2>", *(f"<p>text {i} number {j} of the story</p>" for j in range(3))) for i in range(300)]
    pages[11] = page("<h2>T</h2>", "<p>own text of eleven</p>", "<blockquote><p>quoted</p></blockquote>", "<table><tr><td>cell</td></tr></table>", "<ul><li>one</li><li>two</li></ul>")
    pages[12] = "<html><body><div class=second><p>another</p><p>template</p></div></body></html>"
    group = "".join(f"<h3>h{{0}} {i}</h3><p>p{{0}} {i}</p>" for i in range(9))
    pages[13] = page("<div>" + "</div><div>".join(group.format(k) for k in range(3)) + "</div>")
    got = texts_of(spark, pages)
    assert got[11] == "T\nown text of eleven\nquoted\ncell\none\ntwo"
    assert got[12] == "another\ntemplate"
    assert got[13] == "\n".join(f"h{k} {i}\np{k} {i}" for k in range(3) for i in range(9))
    assert got[299] == "T299\n" + "\n".join(f"text 299 number {j} of the story" for j in range(3))


def test_merges_in_a_tree_accept_all_streams(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 2)
    pages = [page(*(f"<{t}>{t}{i}</{t}>" for j, t in enumerate(("h2", "p", "pre", "ul", "h4")) if i >> j & 1)) for i in range(1, 32)]
    rows = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    (row,) = H.wrappers(rows).collect()
    signs = set(re.findall(r"<[a-z0-9]+", row.wrapper))
    assert {"<h2", "<p", "<pre", "<ul", "<h4"} < signs
    merged = H.merge([H.stream(H.tokenize(h)) for h in pages])
    assert all(H.accepts(H.unify(merged, s), s) for s in map(H.stream, map(H.tokenize, pages[:1])))


def test_copies_of_a_page_keep_their_text(spark):
    copy = page("<h2>Title</h2>", "<p>the first and longest paragraph</p>", "<p>the second one</p>")
    near = [page(f"<h2>Day {i}</h2>", "<p>the first and longest paragraph</p>", "<p>the second one</p>") for i in range(10)]
    others = [page(f"<h2>Other {i}</h2>", f"<p>a paragraph of page {i}</p>") for i in range(2)]
    for pages in ([copy] * 40, [copy] * 40 + others, near + others):
        assert texts_of(spark, pages) == [H.main_text(h, None) for h in pages]
        assert [H.main_text(h, H.infer(pages)) for h in pages] == [H.main_text(h, None) for h in pages]


def test_constant_text_inside_articles_is_no_main_text(spark):
    notice = "<div class=hinweis>Dieser Hinweis steht auf allen Seiten und ist lang</div>"
    for tag in ("article", "main"):
        pages = [f"<{tag}><h1>T{i}</h1><p>story {i}</p>{notice}<p>more of {i}</p><p>Write to us</p></{tag}>" for i in range(6)]
        # The notice is a slot of its own; the last paragraph is one turn of a group of paragraphs, whose texts vary.
        want = [f"T{i}\nstory {i}\nmore of {i}\nWrite to us" for i in range(6)]
        assert texts_of(spark, pages) == want
        assert [H.main_text(h, H.infer(pages)) for h in pages] == want
        assert all(H.main_text(h, None) != w for h, w in zip(pages, want))


def test_slots_decide_between_blocks_of_one_path(spark):
    body = "<div>first of {0}</div><div>second of {0}</div>"
    notices = [f"<article><h1>T{i}</h1><div>Subscribe now</div><h2>S{i}</h2>{body.format(i)}</article>" for i in range(5)]
    assert texts_of(spark, notices) == [f"T{i}\nS{i}\nfirst of {i}\nsecond of {i}" for i in range(5)]
    bylines = [f"<article><h1>T{i}</h1><div>By the newsroom</div>{body.format(i)}</article>" for i in range(5)]
    assert texts_of(spark, bylines) == [f"T{i}\nBy the newsroom\nfirst of {i}\nsecond of {i}" for i in range(5)]
    assert texts_of(spark, notices[:2]) == [H.main_text(h, None) for h in notices[:2]]  # two pages tell nothing


def test_bylines_and_headings_of_all_pages_stay(spark):
    pages = [f"<article><h1>T{i}</h1><p>By the newsroom</p><h2>Summary</h2><p>s{i}</p><div class=x><h4>Hint</h4><p>Call us</p></div><h2>More</h2><p>m{i}</p><p>n{i}</p></article>" for i in range(5)]
    pages[4] = pages[4].replace("<h2>More</h2>", "")
    want = [f"T{i}\nBy the newsroom\nSummary\ns{i}\nMore\nm{i}\nn{i}" for i in range(5)]
    want[4] = want[4].replace("More\n", "")
    assert texts_of(spark, pages) == want


def test_long_groups_fold():
    row = "<section>" + "".join(f"<h{1 + j % 6}>{{0}}.{j}</h{1 + j % 6}><p>{{0}} {j}</p>" for j in range(12)) + "</section>"
    one, many = (H.stream(H.tokenize("<main>" + "".join(row.format(i) for i in range(n)) + "</main>")) for n in (1, 9))
    assert [n[0] for n in many] == ["t", "r", "t"]
    assert H.merge([one, many]) == H.merge([many, one])
    pairs = H.stream(H.tokenize("<dl>" + "<dt>a</dt><dd>b</dd>" * 7 + "</dl>"), 5)
    assert [n[0] for n in pairs] == ["t", "r", "t"] and [n[2] != 0 for n in H._slots(pairs)] == [True, True]
    assert [n[2] for n in H._slots(H.stream(H.tokenize("<ul><li>a<li>b</ul>"), 5))] == [0]


def hostile_pages(spark):
    body = "<article><p>text</p></article>"
    rows = [
        (1, "http://a.example/x", body), (2, "http://a.example/y", body), (2, "http://a.example/y", body), (None, "http://A.example/", body),
        (3, None, body), (4, "no url", None), (5, "http://b.example\r\nX: y", ""), (6, "http://b.example/", "<p>" * 5000), (7, "http://b.example/", "é😀"), (8, "http://u@b.example:80/", ""),
    ]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], PAGES)


def test_hostile_pages(spark):
    rows = H.extract_text(hostile_pages(spark)).collect()
    assert Counter(r.page_id for r in rows) == Counter([1, 2, 2, None, 3, 4, 5, 6, 7, 8])
    assert all(r.text == "text" and r.n_chars == 4 for r in rows if r.page_id in (1, 2, 3, None))
    assert {r.page_id: (r.text, r.n_chars) for r in rows if r.page_id in (4, 5, 7)} == {4: ("", 0), 5: ("", 0), 7: ("é😀", 2)}
    assert H.extract_text(hostile_pages(spark).limit(0)).count() == 0


# Archives


def expected_records(rows, least=0):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    data = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for p, b in data:
        if p is not None and (b not in first or first[b] is None or p < first[b]):
            first[b] = p
    return data, first, digest


def test_records_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "html"))
    data, first, digest = expected_records([(r.page_id, r.html) for r in pages.collect()])
    want = {p: (len(b), digest(b), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in data}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_pages(pages).collect()}
    assert got == want


def test_hostile_records(spark):
    rows = W.archive_pages(hostile_pages(spark)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter(
        [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (6, "response", None), (7, "response", None), (8, "revisit", 4)]
    )
    assert W.archive_pages(hostile_pages(spark).limit(0)).count() == 0
    small = W.archive_pages(hostile_pages(spark), least_bytes=31).collect()
    assert Counter(r.record_type for r in small) == {"response": 10}


def test_records_come_back_byte_for_byte(spark, tmp_path):
    pages = hostile_pages(spark)
    W.write_archive(pages, str(tmp_path / "a"))
    payloads = W.read_payloads(spark, str(tmp_path / "a")).collect()
    assert len(payloads) == len({(r.html or "") for r in pages.collect()})
    records = W.read_bytes(spark, str(tmp_path / "a")).collect()
    assert len(records) == pages.count()
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest.endswith(b"\r\n\r\n")
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(rest) - 4
        payload = rest[:-4].partition(b"\r\n\r\n")[2]
        told = re.search(rb"WARC-Payload-Digest: sha1:(\S+)", head)[1]
        if b"WARC-Type: response" in head:
            assert base64.b32encode(hashlib.sha1(payload).digest()) == told
        else:
            assert payload == b"" and b"WARC-Refers-To: <urn:page:" in head


def test_a_damaged_payload_is_found(spark, tmp_path):
    W.write_archive(hostile_pages(spark), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.withColumn("payload", stored["payload"].substr(2, 10)).write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="digest"):
        W.read_payloads(spark, str(tmp_path / "b")).collect()
