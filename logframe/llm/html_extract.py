"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of block tags and text runs (inline tags belong to the text). Runs of equal neighbours fold into
repeated groups. A host's wrapper starts as one page's stream and is aligned with others, one after the other: tokens
that only one side has become optional groups, a group that is repeated on one side becomes repeated in the wrapper,
text runs become slots. So a wrapper consists of tags, slots, optional groups and repeated groups, without alternatives.
It holds all pages of its host: streams are aligned in a tree of merges.

A slot keeps its text as long as all texts that were aligned with it are equal, in all turns of a repeated group and on
all pages; then it is constant, if three distinct pages or more have it. Otherwise it is a slot for data. What stands in
a constant slot is no main text; tags and class words say what lies beside the text. So a notice that is a slot of its own
goes, and a byline that is one turn of a group of paragraphs, or a paragraph or heading beside text that varies, stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import written

#: Streams or wrappers of a host that one step of the tree merges, on the average.
FAN = 16
#: A slot is constant if so many distinct pages have it, all with the same text.
CONSTANT_PAGES = 3
#: Wrappers of up to so many bytes in all are broadcast; beyond, pages are joined with them by host and salt.
BROADCAST_BYTES = 16 << 20
SALTS = 16

#: Elements whose content is no markup. One that closes itself, as in svg, has none; a longer name is another element.
_RAW = "script|style|textarea|title"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?!/>)(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<![\s"']/)>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base col embed hr input link meta param source track".split())
#: An element that starts ends an open one of these, unless one of the second kind lies between.
_ENDS = {"p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, set())}
_NOT_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements in the middle of text whose content is none of it. They do not part a paragraph, and one that is never closed
#: holds nothing.
_EMBEDDED = frozenset("noscript template iframe svg math select object audio video canvas".split())
#: Elements, and words in class, id or role, of what is not main text.
_SIDE_TAGS = _EMBEDDED | frozenset("nav footer aside form button fieldset menu dialog head option optgroup".split())
_SIDE_WORDS = re.compile(
    r"(?:^|[\s_.#-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|contentinfo|cookies?|discussion|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notice|overlay|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_.#-])",
    re.I,
)
_MAIN_TAGS = ("article", "main")
#: Elements that text is written in, without attributes.
_FLOW = frozenset(["<p", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6"])

#: A token: its sign ("<p", "</p", "#" for text), its text, and the elements that it lies in.
Token = tuple[str, str, tuple[str, ...]]


def _sign(tag: str, attributes: str) -> str:
    named = [f"{m[1].lower()}={_SPACE.sub(' ', re.sub(r'[0-9]+', '0', m[2] or m[3] or m[4] or '')).strip().lower()}" for m in _ATTRIBUTE.finditer(attributes)]
    return " ".join(["<" + tag, *sorted(x for x in named if not x.endswith("="))])


def tokenize(html: str) -> list[Token]:
    """A page's block tags and text runs; character references are decoded and white space in a run is one blank."""
    out: list[Token] = []
    run: list[str] = []
    open_: list[tuple[str, str]] = []
    path: tuple[str, ...] = ()
    #: For each open embedded element its depth, its first token, and the run that it stands in.
    embedded: list[tuple[int, int, list[str]]] = []

    def text() -> None:
        joined = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if joined:
            out.append(("#", joined, path))

    def close(at: int, named: bool = False) -> None:
        nonlocal path
        while len(open_) > at:
            tag = open_[-1][0]
            if embedded and embedded[-1][0] == len(open_) - 1:
                depth, first, around = embedded.pop()
                if named and depth == at:
                    out.append(("</" + tag, "", path))
                    run[:] = around
                else:  # never closed: what follows it belongs to what it stands in
                    before = _SPACE.sub(" ", "".join(around)).strip()
                    out[first:] = [*([("#", before, path[:depth])] if before else []), *((s, t, p[:depth] + p[depth + 1 :]) for s, t, p in out[first + 1 :])]
            else:
                out.append(("</" + tag, "", path))
            open_.pop()
            path = tuple(s for _, s in open_)

    last = 0
    for m in _TOKEN.finditer(html):
        run.append(unescape(html[last : m.start()]))
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in _INLINE:
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _EMBEDDED:
            if m[4].rstrip().endswith("/"):
                continue
            if not m[2]:
                around = list(run)
                run.clear()
                embedded.append((len(open_), len(out), around))
                sign = _sign(tag, m[4])
                out.append((sign, "", path))
                open_.append((tag, sign))
                path = (*path, sign)
                continue
            if not any(t == tag for t, _ in open_):
                continue
        text()
        if m[2]:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if at is not None:
                close(at, named=True)
            continue
        ends, within = _ENDS.get(tag, (set(), set()))
        if tag in _NOT_IN_P:
            ends = ends | {"p", "option", "optgroup"}
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in within or open_[i][0] not in ends | {"li", "dd", "dt", "tr", "td", "th", "p"}:
                break
            if open_[i][0] in ends:
                close(i)
        sign = _sign(tag, m[4])
        out.append((sign, "", path))
        if tag not in _VOID and not m[4].rstrip().endswith("/"):
            open_.append((tag, sign))
            path = (*path, sign)
    run.append(unescape(html[last:]))
    text()
    close(0)
    return out


# A wrapper node: ["t", sign], ["x", place, text, pages], ["o", nodes] or ["r", nodes]; at its end ["w", [element, size of
# its text that varies]...]. Place, text and pages of a slot are hashes: the elements that it lies in, its text (0 if texts
# differ or it lies beside the main text), and some of the distinct pages that have it.


def _key(node: list) -> str:
    if node[0] == "t":
        return node[1]
    return "#" if node[0] == "x" else f"{node[0]}({' '.join(map(_key, node[1]))})"


def _join(a: list, b: list) -> list:
    """The node of two nodes of equal key: a slot keeps its text only if both have the same."""
    if a[0] == "t":
        return a
    if a[0] != "x":
        return [a[0], [_join(x, y) for x, y in zip(a[1], b[1])]]
    same = a[2] == b[2] != 0
    pages = (a[3] if a[3] == b[3] else sorted({*a[3], *b[3]})[:CONSTANT_PAGES]) if same else []
    return ["x", a[1], a[2] if same else 0, pages, *([a[4] + b[4]] if len(a) > 4 else [])]


#: An element, a text or a group among its neighbours: key, nodes, whether it is an element.
Unit = tuple[str, list, bool]


def _fold(units: list[Unit]) -> list[Unit]:
    """Neighbouring equal groups as one repeated group, shortest groups first. A group starts with an element."""
    length, ids = 1, None
    while 2 * length <= len(units):
        if ids is None:
            numbers: dict[str, int] = {}
            ids = np.array([numbers.setdefault(k, len(numbers)) for k, _, _ in units])
            if len(numbers) == len(units):
                break
        same = ids[:-length] == ids[length:]
        at = np.arange(len(same))
        run = np.minimum.accumulate(np.where(same, len(same), at)[::-1])[::-1] - at
        if not (run >= length).any():
            length += 1
            continue
        i, out = 0, []
        while i < len(units):
            if i >= len(run) or run[i] < length or not units[i][2]:
                out.append(units[i])
                i += 1
                continue
            times = int(run[i]) // length + 1
            nodes = [n for u in units[i : i + length] for n in u[1]]
            for t in range(1, times):
                nodes = [_join(x, y) for x, y in zip(nodes, (n for u in units[i + t * length : i + (t + 1) * length] for n in u[1]))]
            group = ["r", nodes]
            out.append((_key(group), [group], False))
            i += times * length
        length, ids = (1, None) if len(out) < len(units) else (length + 1, ids)
        units = out
    return units


def stream(tokens: list[Token], page: int = 0, marked: bool = False) -> list:
    """A page's nodes; if marked, slots end with the numbers of their tokens."""
    levels: list[list[Unit]] = [[]]
    opened: list[list] = []

    def leave(end: list[list]) -> None:
        inside = _fold(levels.pop())
        nodes = [opened.pop(), *(n for u in inside for n in u[1]), *end]
        levels[-1].append((" ".join([nodes[0][1], *(u[0] for u in inside), *(n[1] for n in end)]), nodes, True))

    for i, (sign, text, path) in enumerate(tokens):
        while len(opened) > len(path):  # elements without an end
            leave([])
        if sign == "#":
            block = 0 if _side(path) else _number(*path, text)
            levels[-1].append(("#", [["x", _place(path), block, [page] if block else [], *([[i]] if marked else [])]], False))
        elif sign.startswith("</"):
            leave([["t", sign]])
        else:
            opened.append(["t", sign])
            levels.append([])
    while opened:
        leave([])
    return [n for u in _fold(levels[0]) for n in u[1]]


def _repeated(a: list, b: list) -> list:
    """Nodes of a where a repeated group of b stands once."""
    groups: dict[str, list[list[str]]] = {}
    for g in b:
        if g[0] == "r":
            keys = [_key(n) for n in g[1]]
            if keys not in groups.setdefault(keys[0], []):
                groups[keys[0]].append(keys)
    if not groups:
        return a
    own = [_key(n) for n in a]
    out, i = [], 0
    while i < len(a):
        size = next((len(g) for g in groups.get(own[i], []) if own[i : i + len(g)] == g), 0)
        out.append(["r", a[i : i + size]] if size else a[i])
        i += size or 1
    return out


def accepts(wrapper: list, page: list) -> list | None:
    """The wrapper with a stream that is one of its own, as far as one reading from left to right tells; else None."""
    keys, at, out = [_key(n) for n in page], 0, []
    for n in wrapper:
        own = [_key(x) for x in n[1]] if n[0] == "o" else [_key(n)]
        if keys[at : at + len(own)] == own:
            found = [_join(x, y) for x, y in zip(n[1] if n[0] == "o" else [n], page[at : at + len(own)])]
            out.append(["o", found] if n[0] == "o" else found[0])
            at += len(own)
        elif n[0] == "o":
            out.append(n)
        else:
            return None
    return out if at == len(keys) else None


def unify(wrapper: list, page: list) -> list:
    """The wrapper of both: common nodes stay, a group that is repeated on one side is repeated, the rest is optional."""
    bare = lambda nodes: [x for n in nodes for x in (n[1] if n[0] == "o" else [n])]
    optional = {id(x) for n in (*wrapper, *page) if n[0] == "o" for x in n[1]}
    flat, flat2 = bare(wrapper), bare(page)
    flat, flat2 = _repeated(flat, flat2), _repeated(flat2, flat)
    for n in (*flat, *flat2):
        if n[0] == "r" and n[1] and all(id(x) in optional for x in n[1]):
            optional.add(id(n))
    a, b = [_key(n) for n in flat], [_key(n) for n in flat2]
    out: list = []
    for kind, a1, a2, b1, b2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [["o", [_join(n, m)]] if id(n) in optional or id(m) in optional else _join(n, m) for n, m in zip(flat[a1:a2], flat2[b1:b2])]
            continue
        for part in (flat[a1:a2], flat2[b1:b2]):
            if part:
                out.append(["o", part])
    return out


def merge(streams: list[list]) -> list:
    """The wrapper of some streams or wrappers of one host."""
    wrapper = streams[0]
    for s in streams[1:]:
        known = accepts(wrapper, s)
        wrapper = unify(wrapper, s) if known is None else known
    return wrapper


@lru_cache(100_000)
def _side(path: tuple[str, ...]) -> bool:
    """Whether an element on the path is none of main text. A header inside an article belongs to it."""
    inside = False
    for sign in path:
        tag, _, rest = sign[1:].partition(" ")
        inside = inside or tag in _MAIN_TAGS
        if tag in _SIDE_TAGS or (tag == "header" and not inside):
            return True
        if tag not in ("html", "body", "main") and any(_SIDE_WORDS.search(x.partition("=")[2]) for x in _attributes(rest)):
            return True
    return False


def _attributes(rest: str) -> list[str]:
    return re.findall(r"(?:class|id|role)=.*?(?= (?:class|id|role)=|$)", rest)


def _within(path: tuple[str, ...] | list[str], tag: str) -> bool:
    return any(s[1:].partition(" ")[0] == tag for s in path)


def _slots(nodes: list) -> Iterator[list]:
    for n in nodes:
        if n[0] == "x":
            yield n
        elif n[0] in "or":
            yield from _slots(n[1])


def _number(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(100_000)
def _place(path: tuple[str, ...]) -> int:
    return _number(*path)


def _main_tag(tokens: list[Token]) -> str | None:
    return next((t for t in _MAIN_TAGS if any(s == "#" and _within(p, t) and not _side(p) for s, _, p in tokens)), None)


#: A block that is not beside the text, of a page without article or main: the element that it lies in, place and text,
#: and length. The first two are hashes.
_FACTS = ["element", "block", "size"]


def facts(tokens: list[Token]) -> tuple[int, list[tuple[int, int, int]]]:
    """A page's number and its distinct blocks. Pages are copies if they have the same blocks, whatever their scripts and
    sides are."""
    found = sorted({(p, t) for s, t, p in tokens if s == "#" and not _side(p)})
    page = _number(*(x for p, t in found for x in (*p, "", t)))
    if _main_tag(tokens) is not None:
        return page, []
    return page, [(_place(p[:-1]), _number(*p, t), len(t)) for p, t in found]


def constants(wrapper: list) -> set[int]:
    """Blocks that stand in constant slots."""
    return {x[2] for x in _slots(wrapper) if x[2] and len(x[3]) >= CONSTANT_PAGES}


def infer(pages: list[str]) -> list:
    """The wrapper of a host from its pages; wrappers() does the same for many hosts."""
    streams, held = [[]], {}
    for tokens in filter(None, map(tokenize, pages)):
        page, blocks = facts(tokens)
        streams.append(stream(tokens, page))
        held |= {(element, block): size for element, block, size in blocks}
    wrapper = merge(sorted(streams[1:], key=json.dumps) or streams)
    constant, weights = constants(wrapper), {}
    for (element, block), size in held.items():
        if block not in constant:
            weights[element] = weights.get(element, 0) + size
    return [*wrapper, ["w", sorted([e, w] for e, w in weights.items())]]


def follow(wrapper: list, tokens: list[Token]) -> set[int]:
    """The tokens of a page that stand in constant slots of the wrapper, and have their texts."""
    flat = [x for n in wrapper if n[0] != "w" for x in (n[1] if n[0] == "o" else [n])]
    page = stream(tokens, marked=True)
    flat, page = _repeated(flat, page), _repeated(page, flat)
    told: set[int] = set()

    def walk(known: list, own: list) -> None:
        for n, m in zip(known, own):
            if n[0] == "r":
                walk(n[1], m[1])
            elif n[0] == "x" and n[2] and len(n[3]) >= CONSTANT_PAGES:
                told.update(i for i in m[4] if _number(*tokens[i][2], tokens[i][1]) == n[2])

    for kind, a1, a2, b1, b2 in SequenceMatcher(None, [_key(n) for n in flat], [_key(n) for n in page], autojunk=False).get_opcodes():
        if kind == "equal":
            walk(flat[a1:a2], page[b1:b2])
    return told


def _learned(wrapper: list | None) -> tuple[bool, dict[int, int]]:
    """Whether the wrapper has constant slots, and the elements with the size of their text that varies."""
    weights = wrapper[-1][1] if wrapper and wrapper[-1][0] == "w" else ()
    return bool(wrapper) and bool(constants(wrapper)), dict(weights)


def _container(elements: set[tuple[str, ...]], weights: dict[int, int]) -> tuple[str, ...]:
    """Of the elements that hold the page's text, the one with most of the host's text that varies, or the outermost one
    around it that holds such text as well. Without any it is the whole page."""
    size = {p: weights.get(_place(p), 0) for p in elements}
    best = max(sorted(elements, key=lambda p: (len(p), p)), key=size.__getitem__, default=())
    if not size.get(best):
        return ()
    return next(best[:n] for n in range(len(best) + 1) if size.get(best[:n]))


def main_text(html: str | None, wrapper: list | None, learned: tuple[bool, dict[int, int]] | None = None) -> str:
    """The blocks of main text of a page, in page order, joined by line ends.

    With an article or main element it is what lies in it, otherwise what lies in the element with most text that varies;
    in both cases without what is beside the text, and without what stands in constant slots. In an article, constant
    paragraphs and headings stay if the element that they lie in holds text that varies. A page that is constant for the
    most part, in blocks and in characters, is one of many near copies: nothing of it is left out for that.
    """
    if not html:
        return ""
    tokens = tokenize(html)
    constant, weights = learned or _learned(wrapper)
    told = follow(wrapper, tokens) if constant else ()
    tag = _main_tag(tokens)
    blocks = [(path, text, i in told) for i, (sign, text, path) in enumerate(tokens) if sign == "#" and not _side(path) and (tag is None or _within(path, tag))]
    if tag:
        varied = {path[:n] for path, _, always in blocks if not always for n in (len(path), len(path) - 1)}
        blocks = [(path, text, always and not (path[-1] in _FLOW and path[:-1] in varied)) for path, text, always in blocks]
    same = [text for _, text, always in blocks if always]
    if 2 * len(same) > len(blocks) and 2 * sum(map(len, same)) > sum(len(text) for _, text, _ in blocks):
        return "\n".join(text for _, text, _ in blocks)
    inside = () if tag else _container({path[:-1] for path, _, always in blocks if not always}, weights)
    return "\n".join(text for path, text, always in blocks if not always and path[: len(inside)] == inside)


def host(url: Column) -> Column:
    """The host of a URL in lower case; pages without one share the host ''."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: streams of a host, those of a batch with equal tags as one, and blocks of its pages."""
    names = ["host", "shape", *_FACTS]
    types = [pa.string(), pa.string(), *[pa.int64()] * len(_FACTS)]
    for b in batches:
        rows: list[tuple] = []
        found: dict[tuple[str, str], list] = {}
        for own, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            tokens = tokenize(html)
            if not tokens:
                continue
            page, blocks = facts(tokens)
            nodes = stream(tokens, page)
            key = own, " ".join(map(_key, nodes))
            found[key] = [_join(x, y) for x, y in zip(found[key], nodes)] if key in found else nodes
            rows += [(own, None, *f) for f in blocks]
        rows += [(own, json.dumps(nodes), *[None] * len(_FACTS)) for (own, _), nodes in found.items()]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _merged(shapes: DataFrame) -> DataFrame:
    """host and wrapper (JSON) from all distinct streams, in a tree of merges; hosts are dealt by hashes of streams."""
    rows = shapes.groupBy("host", "shape").agg(F.lit(None)).select("host", F.col("shape").alias("wrapper"), F.xxhash64("shape").alias("place"))
    rows = written(rows, "page-streams")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // FAN))
    rows = rows.withColumn("place", F.pmod("place", F.lit(parts)))

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = merge([json.loads(x) for x in sorted(group.column("wrapper").to_pylist())])
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(found)]), "place": pa.array([key[1].as_py()], pa.int64())})

    while True:
        rows = rows.groupBy("host", "place").applyInArrow(join, "host string, wrapper string, place long")
        if parts == 1:
            return rows.select("host", "wrapper")
        parts = -(-parts // FAN)
        rows = written(rows, "part-wrappers").withColumn("place", F.floor(F.col("place") / FAN))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host, from all of its pages."""
    schema = ", ".join(["host string", "shape string", *(f"{c} long" for c in _FACTS)])
    rows = pages.filter(F.col("html").isNotNull()).select(host(F.col("url")).alias("host"), "html")
    rows = written(rows.mapInArrow(_gather, schema), "page-facts")
    shapes = written(_merged(rows.filter(F.col("shape").isNotNull())), "merged-wrappers")
    blocks = rows.filter(F.col("shape").isNull())

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(own, block) for own, w in zip(*(x.to_pylist() for x in b.columns)) for block in constants(json.loads(w))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["host", "block"])

    constant = shapes.mapInArrow(fixed, "host string, block long")
    varied = blocks.groupBy("host", "element", "block").agg(F.min("size").alias("size")).join(constant, ["host", "block"], "left_anti")
    weights = varied.groupBy("host", "element").agg(F.sum("size").alias("size"))
    weights = weights.groupBy("host").agg(F.collect_list(F.array("element", "size")).alias("weights"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.dumps([*json.loads(w), ["w", sorted(s or [])]]) for _, w, s in zip(*(x.to_pylist() for x in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["host", "wrapper"])

    return shapes.join(weights, "host", "left").select("host", "wrapper", "weights").mapInArrow(add, "host string, wrapper string")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null html is empty and has no text; a null or odd url belongs to the host ''; a null page_id stays null; repeated
    rows give repeated rows, and an empty table none. Pages are read whole.
    """
    spark = pages.sparkSession
    known = written(wrappers(pages), "wrappers")
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    shared = None
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for own, html, wrapper in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                if own not in parsed:
                    if len(parsed) >= 1_000:
                        parsed.clear()
                    told = shared.value.get(own) if shared else wrapper
                    known = json.loads(told) if told else None
                    parsed[own] = known, _learned(known)
                texts.append(main_text(html, *parsed[own]))
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
