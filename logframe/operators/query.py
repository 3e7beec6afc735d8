"""Boolean search text as one Column.

The text is read once, on the driver, and becomes a predicate that Catalyst compiles. Every atom is
two-valued (a null field is false), so NOT keeps entries whose field is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import invert

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.functions import patterns as P
from logframe.operators.filters import block_contains

FIELDS = {
    "level": "level",
    "service": "service",
    "userid": "user_id",
    "user": "user_id",
    "siteid": "site_id",
    "site": "site_id",
    "tenantid": "tenant_id",
    "tenant": "tenant_id",
    "traceid": "trace_id",
    "trace": "trace_id",
    "spanid": "span_id",
    "span": "span_id",
    "logger": "logger",
    "class": "logger",
    "thread": "thread",
    "message": "message",
    "msg": "message",
}

_SPACE = re.escape(P.SPACE_CHARS)
_TOKEN = re.compile(rf'"(?P<phrase>[^"]*)"?|(?P<mark>[()])|(?P<word>[^()"{_SPACE}][^(){_SPACE}]*)')


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def kw(text: str) -> Column:
    """Case-insensitive substring of the message or the raw block."""
    word = F.lower(F.lit(text))
    return _sure(F.contains(F.lower("message"), word)) | _sure(F.contains(F.lower("raw_line"), word))


def field(name: str, value: str) -> Column:
    """A field test: equality for ``level``, substring for the rest; an unknown field is a keyword."""
    if not value.strip(P.SPACE_CHARS):
        return F.lit(True)
    column = FIELDS.get(name.lower())
    if column is None:
        return kw(value)
    wanted = F.lower(F.lit(value))
    return _sure(F.lower(column) == wanted if column == "level" else F.contains(F.lower(column), wanted))


def atom(text: str) -> Column:
    name, value = _field_and_value(text)
    return kw(value) if name is None else field(name, value)


def _field_and_value(text: str) -> tuple[str | None, str]:
    name, colon, value = text.partition(":")
    if colon and name:
        return name.strip(P.TRIM_CHARS), value.strip(P.TRIM_CHARS)
    return None, text


def _combine(op: str, tests: list[Column]) -> Column:
    """A balanced tree of one operator, so that long chains stay shallow."""
    while len(tests) > 1:
        pairs = [tests[i : i + 2] for i in range(0, len(tests), 2)]
        tests = [reduce(lambda a, b: a & b if op == "AND" else a | b, pair) for pair in pairs]
    return tests[0]


class _Level:
    """One level of parentheses: the tests so far, read left to right."""

    def __init__(self, negate: Callable[[Column], Column]) -> None:
        self.negate = negate
        self.tests: list[Column] = []
        self.op = "AND"
        self.pending = "AND"
        self.negated = False

    def add(self, test: Column) -> None:
        test = self.negate(test) if self.negated else test
        if self.pending != self.op and len(self.tests) > 1:
            self.tests = [_combine(self.op, self.tests)]
        self.op, self.negated = self.pending, False
        self.tests.append(test)

    def value(self) -> Column:
        return _combine(self.op, self.tests)


def query_column(
    text: str | None,
    test: Callable[[str], Column] = atom,
    negate: Callable[[Column], Column] = invert,
) -> Column:
    """The predicate of a search text, ``test`` giving the predicate of each term.

    AND and OR bind equally and apply from left to right; NOT binds to the next term. A term that
    follows another without an operator ends the search text, as does a ``)`` too many. An operator
    without an operand counts as true.
    """
    levels = [_Level(negate)]
    want_term = True
    for token in _TOKEN.finditer(text or ""):
        word, mark = token["word"], token["mark"]
        op = word.upper() if word and word.upper() in ("AND", "OR", "NOT") else None
        if want_term:
            if op == "NOT":
                levels[-1].negated = not levels[-1].negated
                continue
            if mark == "(":
                levels.append(_Level(negate))
                continue
            want_term = False
            if op is None and mark is None:
                levels[-1].add(test(word if word is not None else token["phrase"]))
                continue
            levels[-1].add(F.lit(True))
        if op in ("AND", "OR"):
            levels[-1].pending = op
            want_term = True
        elif mark == ")" and len(levels) > 1:
            group = levels.pop().value()
            levels[-1].add(group)
        else:
            break
    if want_term:
        levels[-1].add(F.lit(True))
    while len(levels) > 1:
        group = levels.pop().value()
        levels[-1].add(group)
    return levels[0].value()


def _atom_in_block(text: str) -> Column:
    """A test of the raw block that holds wherever the term's own test holds."""
    name, value = _field_and_value(text)
    column = None if name is None else FIELDS.get(name.lower())
    if column == "service" or (name is not None and not value.strip(P.SPACE_CHARS)):
        return F.lit(True)
    return block_contains(value, ignore_case=True, level=column == "level")


def query_on_block(text: str | None) -> Column:
    """A predicate on the raw block that every match of the search text passes.

    It spares the parser the blocks that cannot match. Nothing follows from a negated term.
    """
    if text is None or not text.strip(P.SPACE_CHARS):
        return F.lit(True)
    return query_column(text, _atom_in_block, lambda _: F.lit(True))


def filter_query(df: DataFrame, text: str | None) -> DataFrame:
    """Entries that match the search text; a blank text keeps all."""
    if text is None or not text.strip(P.SPACE_CHARS):
        return df
    return df.filter(query_column(text))
