"""Line formats, cleaning and times, one row per case."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import logframe as L
from logframe.functions import text as T

AT = "2025-11-05 06:17:08.214"
FULL = f"{AT} node7 INFO  [ann,north,acme] [shop,tr1,sp1] 12345 --- [main] a.b.Cart : Cart saved"
SLIM = f"{AT} INFO  [ann,north,acme] [shop,tr1,sp1] [main] a.b.Cart : Saved"
IDS = {
    "user_id": "ann",
    "site_id": "north",
    "tenant_id": "acme",
    "trace_id": "tr1",
    "span_id": "sp1",
    "thread": "main",
    "logger": "a.b.Cart",
}
NO_IDS = dict.fromkeys(IDS)
TIME = datetime(2025, 11, 5, 6, 17, 8, 214000)

CASES = {
    "full": (FULL, {"log_format": "FULL", "ts": TIME, "level": "INFO", "message": "Cart saved", **IDS}),
    "one colour": ("\x1b[37m" + FULL, {"log_format": "FULL", "message": "Cart saved", **IDS}),
    "two colours": ("\x1b[1m\x1b[31m" + FULL.replace("INFO ", "ERROR"), {"level": "ERROR", **IDS}),
    "iso": (
        "2025-11-05T04:08:51.660217935Z main ERROR Disk is full",
        {
            "log_format": "ISO",
            "ts": datetime(2025, 11, 5, 4, 8, 51, 660217),
            "ts_nano_rem": 935,
            "level": "ERROR",
            "message": "Disk is full",
            **NO_IDS,
        },
    ),
    "iso short fraction": (
        "2025-11-05T04:08:52.3 main WARN x",
        {"ts": datetime(2025, 11, 5, 4, 8, 52, 300000), "ts_nano_rem": 0, "level": "WARN"},
    ),
    "iso long fraction": (
        "2025-11-05T04:08:52.1234567899Z main WARN x",
        {"ts": datetime(2025, 11, 5, 4, 8, 52, 123456), "ts_nano_rem": 789},
    ),
    "slim": (SLIM, {"log_format": "SLIM", "ts": TIME, "message": "Saved", **IDS}),
    "slim no context": (
        SLIM.replace("[ann,north,acme]", "[]"),
        {**IDS, "log_format": "SLIM", "user_id": None, "site_id": None, "tenant_id": None},
    ),
    "slim user only": (
        SLIM.replace("[ann,north,acme]", "[ann]"),
        {**IDS, "user_id": "ann", "site_id": None, "tenant_id": None},
    ),
    "slim extra comma": (SLIM.replace("acme]", "acme,x]"), {**IDS, "tenant_id": "acme,x"}),
    "braces": (
        f"{AT} ERROR [] [shop,,] [NIO /10.9.8.7:6123 by 3 4] a.b.Bus {{:}} Peer went away.",
        {
            "log_format": "SLIM",
            "level": "ERROR",
            "trace_id": None,
            "span_id": None,
            "thread": "NIO /10.9.8.7:6123 by 3 4",
            "logger": "a.b.Bus",
            "message": "Peer went away.",
        },
    ),
    "closing bracket twice": (
        FULL.replace("[main]", "[tailWorker]]"),
        {"log_format": "FULL", "thread": "tailWorker]", "logger": "a.b.Cart"},
    ),
    "unpadded level": (
        FULL.replace("INFO  [", "INFO ["),
        {
            "log_format": "SIMPLE",
            "level": "INFO",
            "message": "[ann,north,acme] [shop,tr1,sp1] 12345 --- [main] a.b.Cart : Cart saved",
            **NO_IDS,
        },
    ),
    "optional token is a level": (f"{AT} INFO ERROR boom", {"log_format": "SIMPLE", "level": "ERROR", "message": "boom"}),
    "simple without host": (f"{AT} WARN started", {"log_format": "SIMPLE", "level": "WARN", "message": "started"}),
    "raw": (
        "    at a.b.C.run(C.java:7)",
        {"log_format": "RAW", "level": "UNKNOWN", "ts": None, "message": "    at a.b.C.run(C.java:7)", **NO_IDS},
    ),
    "markup": (FULL.replace("Cart saved", "<b>1</b>"), {"message": "<b>1</b>"}),
    "quotes": (FULL.replace("Cart saved", "said \"a\" and 'b'"), {"message": "said \"a\" and 'b'"}),
    "long": (FULL.replace("Cart saved", "X" * 10240), {"message": "X" * 10240}),
    "all empty": (
        f"{AT} node7 INFO  [,,] [,,] 1 --- [main] a.b.C : ",
        {**NO_IDS, "log_format": "FULL", "message": None, "thread": "main", "logger": "a.b.C"},
    ),
    "placeholders": (
        f"{AT} INFO  [null,-,N/A] [shop, ,NULL] [main] a.b.C : -",
        {"user_id": None, "site_id": None, "tenant_id": None, "trace_id": None, "span_id": "NULL", "message": None},
    ),
    "line end": (FULL + "\r\n", {"message": "Cart saved", "stack_trace": None}),
    "stack": (
        FULL + "\njava.lang.X: y\n    at a.b.C\n\n",
        {"message": "Cart saved", "stack_trace": "java.lang.X: y\n    at a.b.C"},
    ),
    "separator in fields": (
        SLIM.replace("ann", "a\x01n\x02n").replace("[main]", "[m\x01\x02\x03n]").replace("Saved", "k=1\x01v=2\x01"),
        {"log_format": "SLIM", "user_id": "a\x01n\x02n", "thread": "m\x01\x02\x03n", "message": "k=1\x01v=2"},
    ),
    "separator in raw line": ("x\x01y", {"log_format": "RAW", "message": "x\x01y"}),
    "dollar and backslash": (FULL.replace("Cart saved", r"$1 \2 $"), {"message": r"$1 \2 $"}),
    "impossible date": (FULL.replace("11-05", "02-30"), {"log_format": "FULL", "ts": None, **IDS}),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, block) for i, (block, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "line_number long, raw_line string")
    return {row["line_number"]: row for row in L.parse_entries(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_format(parsed, name):
    block, expected = CASES[name]
    row = parsed[list(CASES).index(name)]
    assert {k: row[k] for k in expected} == expected
    assert row["raw_line"] == block


def test_blank_blocks_give_no_row(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n ",)], "raw_line string")
    assert L.parse_entries(df).count() == 0


@pytest.mark.parametrize(
    "line, expected",
    [
        (SLIM, True),
        ("2025-11-05T04:08:51.660217935Z main ERROR x", True),
        ("\x1b[37m" + SLIM, True),
        ("\x1b[1m\x1b[31m" + SLIM, True),
        ("    at a.b.C.run(C.java:7)", False),
        ("abc", False),
        ("", False),
        (None, False),
        ("2025-11-05 06:17:08:214 INFO  x", False),
        ("2025-11-05 06:17:08.21", False),
        ("2xxx-yy-zz aa:bb:cc.ddd", True),
        ("\x1bno end 2025-11-05 06:17:08.214", False),
    ],
)
def test_new_entry(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(T.is_new_entry(F.col("line"))).first()[0] is expected


def test_filters_stay_above_the_parser(spark, capsys):
    """The regexes run once a row, however many fields are filtered."""
    df = spark.createDataFrame([(SLIM,)], "raw_line string")
    found = L.filter_entries(L.parse_entries(df), level="INFO", user_id="ann", message="Saved")
    found.explain()
    plan = capsys.readouterr().out
    assert found.count() == 1
    # One chain of four patterns and one for colour codes.
    assert plan.count("regexp_replace(") <= 5


def test_time_text(spark):
    df = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ '2025-11-05 06:17:00'), (TIMESTAMP_NTZ '2025-11-05 06:17:05'),
        (TIMESTAMP_NTZ '2025-11-05 06:17:00.12'), (TIMESTAMP_NTZ '2025-11-05 06:17:00.1234'), (NULL) t(ts)""")
    rows = df.select(T.ts_text(F.col("ts")), T.iso_text(F.col("ts"))).collect()
    assert [tuple(r) for r in rows] == [
        ("2025-11-05 06:17:00.000", "2025-11-05T06:17"),
        ("2025-11-05 06:17:05.000", "2025-11-05T06:17:05"),
        ("2025-11-05 06:17:00.120", "2025-11-05T06:17:00.120"),
        ("2025-11-05 06:17:00.123", "2025-11-05T06:17:00.123400"),
        (None, None),
    ]
