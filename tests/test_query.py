"""Search texts against small entries, and the tests they imply for the raw block."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import logframe as L
from logframe.operators.filters import filters_on_block
from logframe.operators.query import query_on_block

FIELDS = "service level message user_id site_id tenant_id trace_id span_id logger thread raw_line".split()
SCHEMA = ", ".join(f"{name} string" for name in FIELDS)


def entry(**fields):
    return tuple({"service": "svc", **fields}.get(name) for name in FIELDS)


def matches(spark, text, **fields):
    df = spark.createDataFrame([entry(**fields)], SCHEMA)
    return L.filter_query(df, text).count() == 1


@pytest.mark.parametrize(
    "text, fields, expected",
    [
        ("pear", {"message": "say pear tart"}, True),
        ("PEAR", {"message": "say pear tart"}, True),
        ("pear", {"raw_line": "x Pear"}, True),
        ('"pear tart"', {"message": "say pear tart"}, True),
        ('"pear tart"', {"message": "pear brave tart"}, False),
        ('"pear tart', {"message": "say pear tart"}, True),
        ("level:error", {"level": "ERROR"}, True),
        ("level:ERR", {"level": "ERROR"}, False),
        ("user:clerk", {"user_id": "HeadClerk"}, True),
        ("userId:clerk", {"user_id": "headclerk"}, True),
        ("trace:abc", {"trace_id": "xABCy"}, True),
        ("spanId:abc", {"span_id": "xabcy"}, True),
        ("class:cart", {"logger": "a.b.Cart"}, True),
        ("thread:pool", {"thread": None}, False),
        ("service:VC", {}, True),
        ("msg:two", {"message": "one Two"}, True),
        ("foo:two", {"message": "one Two"}, True),
        ("07:45:00", {"message": "at 45:00"}, True),
        ("07:45:00", {"message": "at 07:45"}, False),
        ("level:", {"level": "INFO"}, True),
        (":x", {"message": "a :x b"}, True),
        ('message:"two words"', {"message": 'a "two b'}, True),
        ('message:"two words"', {"message": "two words"}, False),
        ('"message:two words"', {"message": "two words"}, True),
        ("level:ERROR AND refused", {"level": "ERROR", "message": "a refused"}, True),
        ("level:ERROR AND refused", {"level": "INFO", "message": "a refused"}, False),
        ("level:ERROR or level:WARN", {"level": "WARN"}, True),
        ("NOT level:DEBUG", {"level": "DEBUG"}, False),
        ("NOT user:x", {"user_id": None}, True),
        ("NOT NOT user:x", {"user_id": None}, False),
        ("(level:ERROR OR level:WARN) AND refused", {"level": "INFO", "message": "refused"}, False),
        ("a OR b AND c", {"message": "a"}, False),
        ("a OR b AND c", {"message": "bc"}, True),
        ("a AND b OR c", {"message": "c"}, True),
        ("a OR b OR c AND d", {"message": "a"}, False),
        ("((((((term))))))", {"message": "term"}, True),
        ("((((((gone))))))", {"message": "term"}, False),
        ("((term", {"message": "term"}, True),
        ("term) AND gone", {"message": "term"}, True),
        ("error refused", {"message": "error"}, True),
        ("error refused OR x", {"message": "refused"}, False),
        ("(error refused) AND gone", {"message": "error"}, True),
        ("a NOT b", {"message": "a b"}, True),
        ("AND OR NOT ()", {"message": "any"}, True),
        ("error AND", {"message": "error"}, True),
        ("NOT", {"message": "any"}, False),
        ("a AND NOT b", {"message": "a b"}, False),
        ("NOT a OR NOT b", {"message": "a"}, True),
        ("", {"message": None}, True),
        (None, {"message": None}, True),
        ("   ", {"message": None}, True),
        ('""', {"message": "x"}, True),
        ('""', {"message": None}, False),
    ],
)
def test_search_text(spark, text, fields, expected):
    assert matches(spark, text, **fields) is expected


def test_long_chains_stay_shallow(spark):
    text = " OR ".join(f"w{i}" for i in range(400)) + " AND NOT x"
    assert matches(spark, text, message="w399")
    assert not matches(spark, text, message="w399 x")


WORDS = ["error", "b", "level:ERROR", "level:unknown", "user:u1", "user:1", "x:9", "logger:", '"a b"', "service:s", "(", ")"]
TERMS = st.lists(st.sampled_from([*WORDS, "AND", "OR", "NOT", "AND NOT"]), max_size=9).map(" ".join)
LINES = [
    "2026-03-10 21:29:42.973 ERROR [u1,s1,t1] [app,tr1,sp1] [main] a.b.C : a b error 9",
    "2026-03-10 21:29:42.973 INFO  [u2] [app,,] [main] a.b.C : error",
    "2026-03-10 21:29:42.973 INFO  [u\x1b[1m1] [app,,] [main] a.b.C : er\x1b[0mror",
    "2026-03-10T11:31:29.123Z main ERROR b 9\nstack error",
    "not an entry, a b",
    "9",
]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=TERMS)
def test_block_test_loses_no_match(spark, text):
    df = spark.createDataFrame([("svc", line) for line in LINES], "service string, raw_line string")
    entries = L.parse_entries(df)
    found = L.filter_query(entries, text)
    assert found.filter(~query_on_block(text)).count() == 0


@pytest.mark.parametrize(
    "wanted",
    [
        {"level": "error"},
        {"level": "Unknown"},
        {"user_id": "u1", "message": "ERROR"},
        {"trace_ids": ["tr1", "zz"], "logger": "A.B"},
        {"message": "error"},
    ],
)
def test_block_filters_lose_no_match(spark, wanted):
    df = spark.createDataFrame([("svc", line) for line in LINES], "service string, raw_line string")
    found = L.filter_entries(L.parse_entries(df), **wanted)
    assert found.count() > 0
    assert found.filter(~filters_on_block(**wanted)).count() == 0


def test_fields_need_no_text_of_their_own(spark):
    df = spark.createDataFrame([entry(level="INFO")], SCHEMA)
    assert df.filter(L.field("level", "info") & ~L.kw("x")).count() == 1
    assert df.filter(~F.coalesce(L.field("thread", "x"), F.lit(True))).count() == 1
