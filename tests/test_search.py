"""Order, caps, pages, windows, searches, sources and exports on small logs."""

import glob
import gzip
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import logframe as L
from logframe.functions import text as X
from logframe.operators.order import page_size
from logframe.plans.search import SearchRequest
from logframe.schema import ENTRY_COLUMNS, ENTRY_SCHEMA
from logframe.sinks import export

START = datetime(2026, 3, 10, 20, 0, 0)


def orders(n, start=START, level=None):
    """Orders of a delivery service, drawn at random, up to three seconds apart."""
    rng, at = random.Random(n), start
    for number in range(n):
        at += timedelta(milliseconds=rng.randrange(200, 3000))
        yield {
            "at": at,
            "level": level or rng.choice(["ERROR", "ERROR", "WARN ", "INFO ", "DEBUG"]),
            "cook": rng.choice(["ada", "bo", "cleo"]),
            "town": rng.choice(["ulm", "graz", "lyon", "pau"]),
            "firm": rng.choice(["north", "south"]),
            "ride": f"ride{rng.randrange(30):02}",
            "leg": f"leg{rng.randrange(300):03}",
            "unit": rng.choice(["Kitchen", "Courier"]),
            "text": f"{rng.choice(['baked', 'packed', 'left with'])} order {number}",
        }


def log_lines(n, start=START, level=None):
    for o in orders(n, start, level):
        ts = o["at"].isoformat(" ", "milliseconds")
        who = f"[{o['cook']},{o['town']},{o['firm']}] [pies,{o['ride']},{o['leg']}]"
        yield f"{ts} oven3 {o['level']} {who} 88 --- [belt-2] pies.{o['unit']} : {o['text']}"


def text(lines):
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "one").mkdir()
    (root / "two").mkdir()
    (root / "one" / "app.log").write_text("no entry\n" + text(log_lines(100)))
    (root / "two" / "web.log").write_text(text(log_lines(60, START + timedelta(minutes=1))))
    (root / "one" / "app.log.1").write_text(text(log_lines(10, level="WARN ")))
    (root / "one" / "app.log.2.gz").write_bytes(gzip.compress(text(log_lines(200)).encode()))
    (root / "one" / "app-spring.log.gz").write_bytes(gzip.compress(text(log_lines(8)).encode()))
    for name in ("application.yml", "applog.1", "web.log.1", "appx.log"):
        (root / "one" / name).write_text("unrelated\n")
    (root / "one" / "app.d").mkdir()
    (root / "one" / "app.d" / "app.log.9").write_text("nested\n")
    for age, name in enumerate(("app-spring.log.gz", "app.log.1", "app.log.2.gz")):
        os.utime(root / "one" / name, (1_700_000_000 - age * 1000,) * 2)
    return root


@pytest.fixture(scope="module")
def catalog(logs):
    return L.service_catalog(
        [
            {"name": "app", "log_file": str(logs / "one" / "app.log"), "color": "#101010"},
            ("web", str(logs / "two" / "web.log")),
            ("gone", str(logs / "two" / "gone.log")),
        ]
    )


def messages(df):
    return [r["message"] for r in df.select("message").collect()]


# --- searches ------------------------------------------------------------------------------------


def test_newest_first_ends_with_untimed(spark, catalog):
    rows = L.search(spark, catalog).page.collect()
    times = [r["ts"] for r in rows]
    assert len(rows) == 161 and times[-1] is None and None not in times[:-1]
    assert times[:-1] == sorted(times[:-1], reverse=True)


def test_oldest_first_ends_with_untimed(spark, catalog):
    times = [r["ts"] for r in L.search(spark, catalog, sort_order="ASC").page.collect()]
    assert times[-1] is None and times[:-1] == sorted(times[:-1])


def test_pages_joined_are_the_view(spark, catalog):
    whole = messages(L.search(spark, catalog, limit=0).page)
    pages = [messages(L.search(spark, catalog, limit=50, start=s).page) for s in (0, 50, 100, 150, 200)]
    assert [len(p) for p in pages] == [50, 50, 50, 11, 0]
    assert sum(pages, []) == whole


def test_keyset_pages_are_the_offset_pages(spark, catalog):
    view = L.search(spark, catalog).view
    for order in ("desc", "asc"):
        seen, after = [], None
        while True:
            rows = L.page_after(view, after, 70, order).collect()
            if not rows:
                break
            seen += [r["raw_line"] for r in rows]
            after = rows[-1]
        assert seen == [r["raw_line"] for r in L.page(view, 0, 0, order).collect()]


WEB_START = START + timedelta(minutes=1)
ALL = [o | {"service": "app"} for o in orders(100)] + [o | {"service": "web"} for o in orders(60, WEB_START)]
ERRORS = [o for o in ALL if o["level"] == "ERROR"]


def second(n):
    return START + timedelta(seconds=n)


# A request, the orders that it finds, and whether it finds the line before the first entry.
FOUND = [
    ({"level": "error"}, lambda o: o["level"] == "ERROR", 0),
    ({"level": "INFO"}, lambda o: o["level"] == "INFO ", 0),
    ({"trace_id": "ride07"}, lambda o: o["ride"] == "ride07", 0),
    ({"trace_ids": ("ride07",), "trace_id": "ride09, ride1"}, lambda o: o["ride"][:5] == "ride1" or o["ride"] in ("ride07", "ride09"), 0),
    ({"span_id": "leg00"}, lambda o: o["leg"].startswith("leg00"), 0),
    ({"user_id": "bo"}, lambda o: o["cook"] == "bo", 0),
    ({"user_id": "BO"}, lambda o: False, 0),
    ({"query": "user:BO"}, lambda o: o["cook"] == "bo", 0),
    ({"site_id": "pau", "tenant_id": "north"}, lambda o: (o["town"], o["firm"]) == ("pau", "north"), 0),
    ({"logger": "courier"}, lambda o: o["unit"] == "Courier", 0),
    ({"message": "ORDER 9"}, lambda o: "order 9" in o["text"], 0),
    ({"services": ("web",)}, lambda o: o["service"] == "web", 0),
    ({"services": ("web", "nope")}, lambda o: o["service"] == "web", 0),
    ({"services": ("nope",)}, lambda o: False, 0),
    ({"from_ts": "2026-03-10 20:01:30"}, lambda o: o["at"] >= second(90), 1),
    ({"to_ts": "2026-03-10 20:00:09"}, lambda o: o["at"] <= second(9), 1),
    ({"from_ts": second(70), "to_ts": second(80)}, lambda o: second(70) <= o["at"] <= second(80), 1),
    ({"query": "level:ERROR AND \"order 5\""}, lambda o: o["level"] == "ERROR" and "order 5" in o["text"], 0),
    ({"query": "NOT trace:ride0"}, lambda o: "ride0" not in o["ride"], 1),
    ({"level": "ERROR", "query": "message:\"5"}, lambda o: False, 0),
]


@pytest.mark.parametrize("request_, test, untimed", FOUND)
def test_filters(spark, catalog, request_, test, untimed):
    result = L.search(spark, catalog, **request_)
    count = sum(map(test, ALL)) + untimed
    assert result.page.count() == count
    assert result.summary().first()["total_matched"] == count


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("order", ["desc", "asc"])
def test_cap_keeps_untimed_entries_in_live_search(spark, catalog, order, bounded):
    view = L.search(spark, catalog, cap=10, sort_order=order, bounded=bounded).view.collect()
    assert len(view) == 11 and sum(r["ts"] is None for r in view) == 1
    df = L.read_services(spark, catalog)
    cut = L.cap_entries(df, order, 10, keep_null_ts=False, bounded=bounded).collect()
    assert len(cut) == 10 and all(r["ts"] is not None for r in cut)
    assert L.cap_entries(df, order, 161, keep_null_ts=False, bounded=bounded).count() == 161
    assert L.cap_entries(df, order, 1000, bounded=bounded).count() == 161


@pytest.mark.parametrize("seed", range(4))
def test_cap_against_plain_sort(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (None if rnd.random() < 0.2 else START + timedelta(seconds=rnd.choice([1, 60, 3600]) * rnd.randrange(9)), i)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, file_offset long").select(
        "*", F.lit(0).alias("ts_nano_rem"), F.lit("s").alias("service"), F.lit("f").alias("file_path")
    )
    for k in (1, 17, 150, 299):
        for order, sign in (("desc", -1), ("asc", 1)):
            keyed = sorted((r for r in rows if r[0]), key=lambda r: (sign * (r[0] - START).total_seconds(), r[1]))
            untimed = [r for r in rows if r[0] is None]
            for keep, expected in ((True, keyed[:k] + untimed), (False, (keyed + untimed)[:k])):
                got = L.cap_entries(df, order, k, keep_null_ts=keep).select("file_offset").collect()
                assert sorted(r[0] for r in got) == sorted(r[1] for r in expected)


@pytest.mark.parametrize("seed", range(2))
def test_bounded_cap_against_plain_sort(spark, monkeypatch, seed):
    monkeypatch.setattr("logframe.operators.order.UNBOUNDED_CAP", 0)
    test_cap_against_plain_sort(spark, seed)


@pytest.mark.parametrize("unbounded", [1000, 0])
def test_passes_before_a_cap(spark, catalog, monkeypatch, capsys, unbounded):
    """A small cap needs none; a large one gets the time of the k-th row and the total from one."""
    monkeypatch.setattr("logframe.operators.order.UNBOUNDED_CAP", unbounded)
    cut = L.cap_entries(L.read_services(spark, catalog), "desc", 10, keep_null_ts=False)
    cut.collect()
    capsys.readouterr()
    cut.explain()
    plan = capsys.readouterr().out
    assert ("ReusedSubquery" in plan) if unbounded == 0 else ("Subquery" not in plan)


def test_untimed_entries_never_push_out_timed_ones(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for i in range(12):
        lines = text(log_lines(1, START + timedelta(minutes=i)))
        (tmp_path / "log" / f"part-{i:03}.log").write_text("banner\n" + lines)
    catalog = L.service_catalog([("s", str(tmp_path / "log"))])
    for bounded in (True, False):
        found = L.search(spark, catalog, cap=10, bounded=bounded).view.collect()
        assert sum(r["ts"] is not None for r in found) == 10 and sum(r["ts"] is None for r in found) == 12
    assert L.search(spark, catalog, limit=0).page.count() == 24


def test_query_before_or_after_the_cap(spark, catalog):
    assert L.search(spark, catalog, query="level:ERROR", cap=20).view.count() == 20
    assert L.search(spark, catalog, query="level:ERROR", cap=20, scan_depth=1000).view.count() == 20
    behind = L.filter_query(L.cap_entries(L.read_services(spark, catalog), "desc", 20), "level:ERROR")
    newest = sorted(ALL, key=lambda o: o["at"])[-20:]
    assert behind.count() == sum(o["level"] == "ERROR" for o in newest) < 20


def test_summary(spark, catalog):
    row = L.search(spark, catalog, query="level:ERROR", limit=30, start=len(ERRORS) - 20).summary().first()
    assert (row["total_matched"], row["filtered_by_structured"], row["page_limit"]) == (len(ERRORS), 161, 30)
    assert row["has_more"] is False and row["sort_order"] == "desc"
    assert set(row["next_offsets"]) == {"app", "web"}
    assert L.search(spark, catalog, limit=30).summary().first()["has_more"] is True


def test_a_cap_shows_in_the_counts(spark, catalog):
    found = L.search(spark, catalog, query="level:ERROR", cap=30)
    row = found.summary().first()
    assert row["total_matched"] == 30 == found.view.count() and row["filtered_by_structured"] == 161


def test_nothing_is_cut_unless_asked_for():
    assert [page_size(n) for n in (None, 0, -1, 7, 60_000)] == [None, None, None, 7, 60_000]
    assert [L.scan_depth(n) for n in (None, 0, 5, 10**9)] == [None, None, 5, 10**9]
    assert SearchRequest().depth is None and SearchRequest().cap is None
    assert not SearchRequest(from_ts="2026-01-01").filtered and SearchRequest(query="x").filtered


# --- scan window ---------------------------------------------------------------------------------


def window(spark, catalog, n=5, **how):
    rows = L.scan_window(L.read_services(spark, catalog, ["app"]), n, **how).collect()
    return sorted(int(r["message"].split()[-1]) if r["ts"] else -1 for r in rows)


def test_scan_window_directions(spark, catalog):
    assert window(spark, catalog) == [95, 96, 97, 98, 99]
    assert window(spark, catalog, order="asc") == [-1, 0, 1, 2, 3]
    assert window(spark, catalog, order="asc", filtered=True) == [95, 96, 97, 98, 99]
    later = [n for n, o in enumerate(orders(100)) if o["at"] >= second(20)]
    assert window(spark, catalog, order="asc", from_ts="2026-03-10 20:00:20", filtered=True) == [-1, *later[:4]]
    assert window(spark, catalog, streamed=True) == [-1, 0, 1, 2, 3]
    assert window(spark, catalog, 1000) == [-1, *range(100)]


def test_scan_window_until(spark, catalog):
    assert window(spark, catalog, to_ts="2026-03-10 20:00:20") == [n for n, o in enumerate(orders(100)) if o["at"] <= second(20)][-5:]


def test_gzip_live_log_is_read_from_its_start(spark, logs):
    catalog = L.service_catalog([("z", str(logs / "one" / "app.log.2.gz")), ("web", str(logs / "two" / "web.log"))])
    found = L.search(spark, catalog, scan_depth=3).page.select("service", "message").collect()
    numbers = sorted((r["service"], int(r["message"].split()[-1])) for r in found)
    assert numbers == [("web", 57), ("web", 58), ("web", 59), ("z", 0), ("z", 1), ("z", 2)]


# --- resume --------------------------------------------------------------------------------------


def test_resume_serves_every_entry_once(spark, catalog):
    df = L.read_services(spark, catalog, ["app"]).filter("ts IS NOT NULL")
    for order in ("desc", "asc"):
        seen, offsets = [], {}
        while True:
            page = L.page(L.resume(df, offsets, order), 30, 0, order)
            rows = page.collect()
            if not rows:
                break
            seen += [r["file_offset"] for r in rows]
            offsets = L.offsets_map(page, order).first()["next_offsets"]
        assert len(seen) == 100 and len(set(seen)) == 100
        assert seen == sorted(seen, reverse=order == "desc")


@pytest.fixture(scope="module")
def several_files(tmp_path_factory):
    """Two services of three files each, whose times overlap."""
    root = tmp_path_factory.mktemp("several")
    for k, service in enumerate(("red", "blue")):
        (root / service).mkdir()
        for i in range(3):
            start = START + timedelta(seconds=40 * i + k)
            (root / service / f"part-{i}.log").write_text("banner\n" + text(log_lines(60, start)))
    return L.service_catalog([(s, str(root / s)) for s in ("red", "blue")])


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_pages_behind_the_last_entry_are_the_view(spark, several_files, order):
    key = lambda r: (r["file_path"], r["file_offset"])
    seen, after = [], None
    while True:
        rows = L.search(spark, several_files, limit=100, sort_order=order, after=after).page.collect()
        if not rows:
            break
        seen += map(key, rows)
        after = rows[-1]
    assert len(seen) == 366 and seen == [key(r) for r in L.search(spark, several_files, limit=0, sort_order=order).page.collect()]


def test_a_byte_cursor_of_several_files_is_refused(spark, several_files):
    with pytest.raises(ValueError, match="several files"):
        L.search(spark, several_files, service_offsets={"red": 500})


def test_service_cursor_beats_the_global_one(spark, catalog):
    df = L.read_services(spark, catalog)
    got = L.resume(df, {"app": 500}, "desc", default=0).groupBy("service").agg(F.max("file_offset")).collect()
    assert [r["service"] for r in got] == ["app"] and got[0][1] < 500


# --- rotated logs --------------------------------------------------------------------------------


def test_list_rotated(spark, catalog):
    rows = L.list_rotated(spark, catalog, "app").collect()
    assert [r["name"] for r in rows] == ["app-spring.log.gz", "app.log.1", "app.log.2.gz"]
    assert all(r["size_kb"] >= 1 for r in rows)
    assert rows[0]["last_modified"] == "2023-11-14T22:13:20Z"
    assert L.list_rotated(spark, catalog, "unknown").count() == 0
    nowhere = L.service_catalog([("x", "/nowhere/x.log")])
    assert L.list_rotated(spark, nowhere, "x").count() == 0


@pytest.mark.parametrize(
    "name, count", [("app.log.1", 10), ("app.log.2.gz", 200), ("app-spring.log.gz", 8)]
)
def test_search_file(spark, catalog, name, count):
    rows = L.search_file(spark, catalog, "app", name).page.collect()
    assert len(rows) == count and {r["service"] for r in rows} == {"app"}
    assert rows[0]["ts"] == max(r["ts"] for r in rows)


@pytest.mark.parametrize(
    "service, name",
    [
        ("unknown", "app.log.1"),
        ("a/b", "app.log.1"),
        ("app", "../one/app.log.1"),
        ("app", "x/app.log.1"),
        ("app", "app..log"),
        ("app", "app.log"),
        ("app", "web.log.1"),
        ("app", "application.yml"),
        ("app", "appx.log"),
        ("app", "app.log.7"),
        ("app", "app log"),
    ],
)
def test_search_file_rejects(spark, catalog, service, name):
    with pytest.raises(ValueError):
        L.search_file(spark, catalog, service, name)


def test_service_status(spark, catalog, logs):
    rows = {r["name"]: r for r in L.service_status(spark, catalog).collect()}
    size = os.path.getsize(logs / "one" / "app.log")
    assert rows["app"]["color"] == "#101010" and rows["web"]["color"] == "#1a6fa3"
    assert rows["app"]["size_kb"] == size // 1024 and rows["app"]["exists"]
    assert rows["gone"]["exists"] is False and rows["gone"]["last_modified"] == "N/A"
    assert rows["gone"]["size_kb"] == 0


def test_read_catalog(spark, tmp_path):
    path = tmp_path / "services.json"
    path.write_text('{"name":"a","log_file":"/x/a.log"}\n{"name":"b","log_file":"/x/b.log","color":"#fff"}\n')
    assert sorted(L.read_catalog(spark, str(path)), key=lambda s: s.name) == [
        L.Service("a", "/x/a.log"),
        L.Service("b", "/x/b.log", "#fff"),
    ]


def test_a_damaged_log_fails_unless_asked(spark, tmp_path):
    whole = gzip.compress(text(log_lines(3000)).encode())
    (tmp_path / "half.log.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "whole.log.gz").write_bytes(whole + gzip.compress(text(log_lines(5)).encode()))
    catalog = L.service_catalog([("h", str(tmp_path / "half.log.gz")), ("w", str(tmp_path / "whole.log.gz"))])
    assert L.read_services(spark, catalog, ["w"]).count() == 3005
    with pytest.raises(Exception, match="half.log.gz|end of input|EOF|Unexpected end"):
        L.read_services(spark, catalog).count()
    n = L.read_services(spark, catalog, ["h"], skip_damaged=True).count()
    assert 0 < n < 3000
    named = [r[0] for r in L.damaged_files(spark, str(tmp_path)).collect()]
    assert [os.path.basename(p) for p in named] == ["half.log.gz"]


# --- presets and table ---------------------------------------------------------------------------


def test_last_preset(spark, catalog):
    df = L.read_services(spark, catalog, ["app"])
    assert L.last(df, "5m", now="2026-03-10 20:06:00").count() == sum(o["at"] >= second(60) for o in orders(100)) + 1
    assert L.last(df, "24h").count() == 1


def test_table(spark, catalog, tmp_path, capsys):
    path = str(tmp_path / "entries")
    entries = L.read_services(spark, catalog)
    L.write_entries(entries, path)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        L.write_entries(entries, path)
    table = L.read_entries(spark, path)
    columns = [c for c in ENTRY_COLUMNS if c != "service"]
    assert table.select("service", *columns).exceptAll(entries.select("service", *columns)).count() == 0
    assert table.count() == 161
    found = L.search_table(table, from_ts="2026-03-10 20:01:30", services=("app",), level="ERROR")
    assert found.page.count() == sum(o["service"] == "app" and o["at"] >= second(90) for o in ERRORS)
    found.structural.select("ts").explain()
    plan = capsys.readouterr().out
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "log_date" in partitions and "service" in partitions
    assert "raw_line" not in plan.split("ReadSchema:")[1]


# --- exports -------------------------------------------------------------------------------------


def parts(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))


def exported(spark):
    row = dict.fromkeys(ENTRY_COLUMNS)
    base = {**row, "service": "s", "level": "INFO", "ts_nano_rem": 0, "file_offset": 1}
    rows = [
        {**base, "ts": datetime(2026, 3, 10, 20, 0, 1), "message": 'a,"b"', "raw_line": "raw 1", "line_number": 3},
        {**base, "ts": datetime(2026, 3, 10, 20, 0, 0), "message": "=1+1", "raw_line": " ", "thread": "t",
         "stack_trace": "x\ny", "line_number": 1},
        {**base, "ts": None, "message": "-x\ry", "raw_line": "raw 3\nmore", "line_number": 2},
    ]
    return spark.createDataFrame([Row(**r) for r in rows], ENTRY_SCHEMA)


def test_write_csv(spark, tmp_path):
    expected = (
        "\ufeffTimestamp,Level,Service,Logger,Thread,TraceId,SpanId,UserId,SiteId,TenantId,Message,StackTrace\n"
        '2026-03-10 20:00:01.000,INFO,s,,,,,,,,"a,""b""",\n'
        '2026-03-10 20:00:00.000,INFO,s,,t,,,,,,\t=1+1,"x\ny"\n'
        ',INFO,s,,,,,,,,"\t-x\ry",\n'
    )
    path = f"{tmp_path}/csv"
    L.write_csv(exported(spark), path)
    assert parts(path).decode() == expected


def test_rebuilt_text_has_nanoseconds(spark):
    row = spark.range(1).select(
        F.lit("2026-03-10 20:00:01.123456").cast("timestamp_ntz").alias("a"), F.lit("2026-03-10 20:00:00").cast("timestamp_ntz").alias("b")
    )
    texts = row.select(X.iso_text(F.col("a"), F.lit(7)), X.iso_text(F.col("b"), F.lit(89)), X.iso_text(F.col("b"), F.lit(0))).first()
    assert tuple(texts) == ("2026-03-10T20:00:01.123456007", "2026-03-10T20:00:00.000000089", "2026-03-10T20:00")


def test_write_txt(spark, tmp_path):
    L.write_txt(exported(spark), f"{tmp_path}/txt", "asc")
    fallback = "2026-03-10T20:00 INFO [t]  - =1+1\nx\ny"
    assert parts(f"{tmp_path}/txt").decode() == f"{fallback}\n\nraw 1\n\nraw 3\nmore\n\n"


def test_json_rows(spark, tmp_path):
    rows = [json.loads(r["value"]) for r in export.to_json_rows(L.order_entries(exported(spark))).collect()]
    assert rows[0] == {
        "service": "s",
        "timestamp": "2026-03-10 20:00:01.000",
        "level": "INFO",
        "message": 'a,"b"',
        "rawLine": "raw 1",
        "lineNumber": 3,
    }
    L.write_json(exported(spark), f"{tmp_path}/json")
    assert [json.loads(line) for line in parts(f"{tmp_path}/json").decode().splitlines()] == rows
