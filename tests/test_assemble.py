"""Blocks over many splits, checked against a plain reading of the file."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

import logframe as L

NEW = re.compile(r"(?s)^(?:\x1B[^m]*m)*\d.{3}-.{2}-.{2}[ T].{2}:.{2}:.{2}\..{3}")


def plain_reading(data: bytes, keep_blank=False, keep_orphan=True):
    """(entry number, line, first byte, text) of each block, by one pass over the lines."""
    entries, at, seq = {}, 0, 0
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    for number, raw in enumerate(lines, 1):
        line = raw.decode().removesuffix("\r")
        new = bool(NEW.match(line))
        seq += new
        if new or keep_blank or line.strip():
            entries.setdefault(seq, (number, at, []))[2].append(line)
        at += len(raw) + 1
    blocks = [(s, n, a, "\n".join(text)) for s, (n, a, text) in entries.items()]
    return sorted(b for b in blocks if keep_orphan or b[0] > 0)


def log(seed: int, entries=60, orphans=2, newline="\n", giant=0) -> bytes:
    rnd = random.Random(seed)
    lines = [f"orphan {i} é" for i in range(orphans)]
    for i in range(entries):
        colour = "\x1b[37m" if rnd.random() < 0.3 else ""
        lines.append(f"{colour}2026-03-10 21:{i // 60:02}:{i % 60:02}.{rnd.randrange(1000):03} INFO  [] [a,,] [m] l : Grüße {i}")
        for k in range(rnd.choice([0, 0, 0, 1, 5, 30])):
            lines.append(rnd.choice(["", "  ", f"\tat x.y.Z{k}", "日本語 " * rnd.randrange(4)]))
        if giant and i == entries // 2:
            lines += [f"\tat giant frame {k}" for k in range(giant)]
    return (newline.join(lines) + newline).encode()


def assembled(spark, path, **flags):
    blocks = L.assemble_entries(L.read_log_lines(spark, path), **flags)
    rows = blocks.select("entry_seq", "line_number", "file_offset", "raw_line").collect()
    return sorted(map(tuple, rows))


CASES = {
    "plain": log(1),
    "crlf": log(2, newline="\r\n"),
    "no orphans": log(3, orphans=0),
    "giant entry over many splits": log(4, giant=300),
    "only orphans": log(5, entries=0, orphans=200),
    "giant orphan head": log(6, orphans=150),
    "no line end": log(7).rstrip(b"\n"),
    "blank start": b"\n\n" + log(8),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("flags", [{}, {"keep_blank": True, "keep_orphan": False}], ids=["default", "forward"])
def test_blocks_over_splits(spark, tiny_splits, tmp_path, name, flags):
    path = tmp_path / "app.log"
    path.write_bytes(CASES[name])
    lines = L.read_log_lines(spark, str(path))
    if len(CASES[name]) > 2000:
        assert lines.select("split_start").distinct().count() > 3
    assert assembled(spark, str(path), **flags) == plain_reading(CASES[name], **flags)


def test_split_size_does_not_matter(spark, tiny_splits, tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(CASES["giant entry over many splits"])
    results = []
    for size in ("100", "777", "5000", "10000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        results.append(assembled(spark, str(path)))
    assert all(r == results[0] for r in results)


def test_no_line_is_lost(spark, tiny_splits, tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(CASES["plain"])
    blocks = assembled(spark, str(path), keep_blank=True)
    assert "\n".join(text for *_, text in blocks) + "\n" == CASES["plain"].decode()


def test_gzip_reads_like_plain(spark, tiny_splits, tmp_path):
    path = tmp_path / "app.log.1.gz"
    path.write_bytes(gzip.compress(CASES["plain"]))
    assert assembled(spark, str(path)) == plain_reading(CASES["plain"])


def test_absent_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "a.log").write_bytes(CASES["plain"])
    paths = [str(tmp_path / name) for name in ("empty.log", "gone.log", "a.log")]
    assert L.read_log_lines(spark, paths).select("file_path").distinct().count() == 1
    assert L.read_log_lines(spark, paths[1]).count() == 0
    assert assembled(spark, paths[0]) == []


def test_text_is_not_shuffled(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(CASES["plain"])
    catalog = L.service_catalog([("app", str(path))])
    for df in (L.read_services(spark, catalog).select("raw_line", "file_offset"), L.read_services(spark, catalog).agg(F.count("*"))):
        final = final_plan(df)
        # One scan for the blocks, one for the edges of splits, whose shuffle all other readers use again.
        assert final.count("FileScan text") == 2
        assert final.count("REPARTITION_BY_COL") == 1


def final_plan(df):
    df.collect()
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue().split("Initial Plan")[0]


def test_shared_and_special_paths(spark, tmp_path):
    folder = tmp_path / "my logs+1"
    folder.mkdir()
    (folder / "app.log").write_bytes(CASES["plain"])
    (folder / "app.log2").write_bytes(CASES["crlf"])
    one, two = str(folder / "app.log"), str(folder / "app.log2")
    catalog = L.service_catalog([("a", one), ("b", one), ("c", f"file:{two}"), ("d", str(folder / "gone"))])
    counts = L.read_services(spark, catalog).groupBy("service").agg(F.count("*").alias("n")).collect()
    n, m = len(plain_reading(CASES["plain"])), len(plain_reading(CASES["crlf"]))
    assert {r["service"]: r["n"] for r in counts} == {"a": n, "b": n, "c": m}
    assert {r["service"] for r in L.read_services(spark, catalog, ["c", "x"]).select("service").collect()} == {"c"}
    assert L.read_services(spark, catalog, ["x"]).count() == 0


def test_an_entry_costs_no_more_than_its_lines(spark, tmp_path):
    """No window gathers the lines of an entry; one of 40,000 lines comes back whole."""
    lines = [f"2026-03-10 20:00:00.000 INFO  [] [app,,] [m] a.b : long", *(f"\tat line {i}" for i in range(40_000))]
    (tmp_path / "long.log").write_text("\n".join(lines) + "\n")
    blocks = L.assemble_entries(L.read_log_lines(spark, str(tmp_path / "long.log")))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "collect_list" in x]
    rows = blocks.collect()
    assert len(rows) == 1 and rows[0]["raw_line"] == "\n".join(lines)
