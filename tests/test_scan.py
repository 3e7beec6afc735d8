"""Blocks put together in the scan, windows of it, the log index, damaged logs, positions and one-pass counts."""

import gzip
import os
import random
import time

import pytest
from pyspark.sql import functions as F

import logframe as L
from logframe.operators.scan import BlockScan
from logframe.sources.log_index import wanted_entries
from logframe.sources.logs import scan_blocks
from registered import queries as Q
from tests.test_assemble import CASES, final_plan, plain_reading

FLAGS = [{}, {"keep_blank": True, "keep_orphan": False}]


def rows_of(blocks):
    return sorted(map(tuple, blocks.select("entry_seq", "line_number", "file_offset", "raw_line").collect()))


HARD = [("giant entry over many splits", 0), ("giant orphan head", 0), ("blank start", 1), ("crlf", 1), ("no line end", 0)]


@pytest.mark.parametrize("name, flags", [(name, FLAGS[i]) for name, i in HARD])
def test_scan_gives_the_blocks_and_windows_of_a_plain_reading(spark, tiny_splits, tmp_path, name, flags):
    path = tmp_path / "app.log"
    path.write_bytes(CASES[name])
    scan = scan_blocks(spark, L.service_catalog([("app", str(path))]), **flags)
    want = plain_reading(CASES[name], **flags)
    assert rows_of(scan.blocks()) == want
    for oldest in (False, True):
        assert rows_of(scan.blocks(scan.window(7, oldest))) == (want[:7] if oldest else want[-7:])


def test_windows_go_through_the_files_of_each_service(spark, tiny_splits, tmp_path):
    names = ("plain", "crlf", "no orphans")
    for i, name in enumerate(names):
        (tmp_path / f"part-{i}").write_bytes(CASES[name])
    (tmp_path / "part-3").write_bytes(b"")
    one = str(tmp_path / "part-2")
    scan = scan_blocks(spark, L.service_catalog([("all", str(tmp_path)), ("one", one), ("gone", one + "x")]))
    blocks = [(i, *b) for i, name in enumerate(names) for b in plain_reading(CASES[name])]
    for n in (5, 70, 1000):
        found = scan.blocks(scan.window(n, oldest=False)).select("service", F.right("file_path", F.lit(1)).cast("int"), "entry_seq", "raw_line").collect()
        assert sorted(tuple(r)[1:] for r in found if r[0] == "all") == [(i, s, t) for i, s, _, _, t in blocks][-n:]
        assert sorted(r[2] for r in found if r[0] == "one") == [s for i, s, *_ in blocks if i == 2][-n:]


def test_a_window_scans_fewer_lines_than_it_has(spark, tiny_splits, tmp_path):
    (tmp_path / "app.log").write_bytes(CASES["giant entry over many splits"])
    scan = scan_blocks(spark, L.service_catalog([("app", str(tmp_path / "app.log"))]))
    splits = scan.splits.count()
    window = scan.window(3, oldest=False).collect()
    needed = scan.splits.filter((F.col("base_new") + F.col("n_new") >= window[0].low) & (F.col("base_new") <= window[0].high)).count()
    assert 0 < needed < splits / 3


def test_a_long_entry_goes_on_in_further_blocks(spark, tiny_splits, tmp_path):
    data = CASES["giant entry over many splits"] + b"".join(b"no entry %d\n" % i for i in range(300))
    (tmp_path / "app.log").write_bytes(data)
    (tmp_path / "none.log.gz").write_bytes(gzip.compress(b"".join(b"binary %d\n" % i for i in range(50_000))))
    for path, want in ((tmp_path / "app.log", plain_reading(data)), (tmp_path / "none.log.gz", None)):
        files = L.list_log_files(spark, L.service_catalog([("app", str(path))]))
        scan = BlockScan(L.read_log_lines(spark, str(path)), files, limit=1000)
        parts = sorted(map(tuple, scan.blocks().select("entry_seq", "file_offset", "line_number", "raw_line").collect()))
        whole = {}
        for seq, _, line, text in parts:
            whole.setdefault(seq, []).append(text)
        if want:
            assert {s: "\n".join(x) for s, x in whole.items()} == {s: t for s, _, _, t in want}
            assert [x[0] for x in parts if len(whole[x[0]]) == 1] == [s for s, _, _, t in want if len(whole[s]) == 1]
        else:
            assert "\n".join(whole[0]) == "\n".join(f"binary {i}" for i in range(50_000))
            assert len(whole[0]) > 3 and [x[2] for x in parts] == sorted({x[2] for x in parts})
        assert max(len(t) for x in whole.values() for t in x) < 200_000
        assert len(parts) > len(whole)


# --- log index -----------------------------------------------------------------------------------


def day_log(day, n=120, orphan=False):
    rng = random.Random(day)
    lines = ["started"] if orphan else []
    for i in range(n):
        lines.append(f"2026-04-{day:02} {i // 10:02}:{i % 10:02}:00.{rng.randrange(1000):03} INFO  [] [a,tr{rng.randrange(9)},] [m] l : day {day} number {i}")
        lines += ["\tat frame"] * rng.choice([0, 0, 2])
    return "\n".join(lines) + "\n"


@pytest.fixture
def days(spark, tmp_path, tiny_splits):
    root = tmp_path / "logs 1"
    root.mkdir()
    for day in range(1, 7):
        (root / f"part-{day}").write_text(day_log(day, orphan=day == 4))
    (root / "empty").write_text("")
    catalog = L.service_catalog([("app", str(root))])
    L.write_log_index(spark, catalog, str(tmp_path / "index"))
    return catalog, root, L.read_log_index(spark, str(tmp_path / "index"))


RANGES = [
    {"from_ts": "2026-04-02 03:00:00", "to_ts": "2026-04-02 04:00:00"},
    {"from_ts": "2026-04-05 11:00:00"},
    {"to_ts": "2026-04-01 01:00:00", "query": "tr3"},
    {"from_ts": "2030-01-01 00:00:00"},
]


@pytest.mark.parametrize("request_", RANGES)
def test_a_search_by_index_is_the_search_without(spark, days, request_):
    catalog, _, index = days
    columns = ("file_path", "line_number", "file_offset", "raw_line")
    want = sorted(map(tuple, L.search(spark, catalog, limit=0, **request_).page.select(*columns).collect()))
    got = sorted(map(tuple, L.search(spark, catalog, index=index, limit=0, **request_).page.select(*columns).collect()))
    assert got == want and want


def read_files(spark, catalog, index, **request_):
    wanted = wanted_entries(spark, catalog, index, request_.get("from_ts"), request_.get("to_ts"))
    return sorted(r.file_path.rpartition("/")[2] for r in wanted.select("file_path").distinct().collect())


def test_only_files_of_the_range_are_read(spark, days):
    catalog, root, index = days
    # The lines before the first entry of part-4 have no time, so they are in every range.
    assert read_files(spark, catalog, index, **RANGES[0]) == ["part-2", "part-4"]
    assert read_files(spark, catalog, index, **RANGES[3]) == ["part-4"]
    found = wanted_entries(spark, catalog, index, **RANGES[0]).collect()
    assert {r.file_path.rpartition("/")[2]: (r.low, r.high) for r in found} == {"part-2": (1, 120), "part-4": (0, 120)}


def test_changed_and_new_files_are_read_in_full(spark, days, tmp_path):
    catalog, root, index = days
    with open(root / "part-1", "a") as log:
        log.write("2026-04-02 03:30:00.000 INFO  [] [a,late,] [m] l : late entry\n")
    (root / "part-9").write_text(day_log(9))
    assert read_files(spark, catalog, index, **RANGES[0]) == ["part-1", "part-2", "part-4", "part-9"]
    messages = {r.message for r in L.search(spark, catalog, index=index, limit=0, **RANGES[0]).page.collect()}
    assert "late entry" in messages
    before = index.filter("file_path like '%part-2'").collect()
    L.write_log_index(spark, catalog, str(tmp_path / "next"), known=index)
    newer = L.read_log_index(spark, str(tmp_path / "next"))
    assert newer.filter("file_path like '%part-2'").collect() == before
    assert read_files(spark, catalog, newer, **RANGES[0]) == ["part-1", "part-2", "part-4"]
    assert newer.groupBy("file_path").count().count() == 7  # an empty file is not listed


def test_pieces_of_one_file(spark, days, tmp_path, monkeypatch):
    monkeypatch.setattr("logframe.sources.log_index.PIECE", 10)
    catalog, _, _ = days
    L.write_log_index(spark, catalog, str(tmp_path / "fine"))
    index = L.read_log_index(spark, str(tmp_path / "fine"))
    found = wanted_entries(spark, catalog, index, **RANGES[0]).orderBy("file_path", "low").collect()
    # Entries without a time are only in the first piece of part-4, the range only in two pieces of part-2.
    assert [(r.file_path[-1], r.low, r.high) for r in found] == [("2", 30, 49), ("4", 0, 9)]
    for request_ in RANGES:
        got, want = (sorted(r.raw_line for r in L.search(spark, catalog, limit=0, **x, **request_).page.collect()) for x in ({"index": index}, {}))
        assert got == want


# --- damaged logs, cursors -----------------------------------------------------------------------


def test_searches_survive_a_damaged_service(spark, tmp_path):
    whole = gzip.compress("".join(day_log(d, 2000) for d in (1, 2)).encode())
    (tmp_path / "a.log").write_text(day_log(1))
    (tmp_path / "b.log.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "c.log.gz").write_bytes(whole)
    catalog = L.service_catalog([(x, f"{tmp_path}/{x}.log{z}") for x, z in (("a", ""), ("b", ".gz"), ("c", ".gz"))])
    with pytest.raises(Exception):
        L.search(spark, catalog).page.collect()
    found = L.search(spark, catalog, skip_damaged=True, limit=0)
    counts = {r["service"]: r["count"] for r in found.page.groupBy("service").count().collect()}
    assert counts["a"] == 120 and counts["c"] == 2000 and 0 < counts.get("b", 1) < 2000
    assert [(r.service, r.file_path[-8:]) for r in found.damaged.collect()] == [("b", "b.log.gz")]
    assert L.search(spark, catalog, services=("a", "c")).damaged.count() == 0


def test_byte_cursors_are_checked_by_the_listing(spark, days):
    catalog, root, _ = days
    with pytest.raises(ValueError, match="several files"):
        L.search(spark, catalog, service_offsets={"app": 100})
    one = L.service_catalog([("app", str(root / "part-1"))])
    assert L.search(spark, one, service_offsets={"app": 100}, limit=0).page.count() < 120


# --- positions, counts ---------------------------------------------------------------------------


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_positions_are_those_of_the_order(spark, tmp_path, order):
    times = [None if i % 7 == 0 else f"2026-01-01 00:00:0{i % 3}" for i in range(3000)]  # hot times, many without one
    df = spark.createDataFrame([(t, 0, f"s{i % 2}", "f", i) for i, t in enumerate(times)], "t string, ts_nano_rem int, service string, file_path string, file_offset long")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz")).repartition(9)
    want = [r.file_offset for r in L.order_entries(df, order).collect()]
    found = L.numbered(df, str(tmp_path / "sorted"), order).collect()
    assert [r.file_offset for r in sorted(found, key=lambda r: r.position)] == want
    assert sorted(r.position for r in found) == list(range(3000))


@pytest.mark.parametrize("request_", [{}, {"limit": 7, "start": 5}, {"limit": 0}, {"limit": 3, "cap": 50, "query": "tr3"}, {"limit": 9, "cap": 4}, {"sort_order": "asc", "limit": 11, "cap": 11}])
def test_page_and_counts_come_from_one_job(spark, days, request_):
    catalog, _, _ = days
    found = L.search(spark, catalog, **request_)
    view = found.view.collect()
    row = found.summary().first()
    size, start = request_.get("limit", 500) or len(view), request_.get("start", 0)
    assert row["total_matched"] == len(view) and row["filtered_by_structured"] == 721
    assert row["has_more"] == (start + size < len(view))
    if request_.get("limit") != 0:
        rows, counted = found.fetch()
        assert rows == found.page.collect()
        assert counted.first() == row
    else:
        with pytest.raises(ValueError):
            found.fetch()


def test_a_listing_of_many_folders_takes_few_tasks(spark, tmp_path):
    for i in range(260):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "app.log").write_text("2026-04-02 03:30:00.000 INFO  [] [a,,] [m] l : one\n")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("many folders", "")
    files = L.list_log_files(spark, L.service_catalog([("app", str(tmp_path))]))
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("many folders") for s in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 200
    assert files.count() == 260
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_searches_of_one_written_scan(spark, days, tmp_path):
    catalog, _, _ = days
    scan = L.scan_blocks(spark, catalog).written(str(tmp_path / "scan"))
    columns = ("file_path", "line_number", "file_offset", "raw_line")
    after = None
    for _ in range(3):
        want = L.search(spark, catalog, limit=50, after=after).page
        got = L.search(spark, catalog, limit=50, after=after, scan=scan).page
        assert got.select(*columns).collect() == want.select(*columns).collect()
        assert final_plan(got).count("FileScan text") == 1
        after = want.tail(1)[0]
    with pytest.raises(ValueError):
        L.search(spark, catalog, scan=scan, keep_blank=True)


def test_resume_pages_searches_once_a_page(spark, monkeypatch):
    read = []
    monkeypatch.setattr(Q, "placed", lambda df: read.append(df) or df.select("service", "file_offset"))
    Q.resume_pages(spark, "/root/testdata/sf0.001").collect()
    assert len(read) == 4 and all("FileScan text" not in final_plan(df) for df in read)
