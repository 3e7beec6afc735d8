"""Run registered queries against their SQL oracles: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(map(repr, row)) for row in values.itertuples(index=False, name=None)))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns]
    if len(got) and [t for t in types if t[1] != t[2]]:
        return f"types {[t for t in types if t[1] != t[2]]}"
    a, b = rows(got), rows(want)
    if a != b:
        extra, lack = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(a)} rows, expected {len(b)}; only here {extra}; only expected {lack}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    con, failed = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                problem = f"no oracle, {query(spark, sf_dir).count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:26} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print("unused oracles", sorted(set(oracles) - set(entry.queries())), "failed", failed)


if __name__ == "__main__":
    main()
