"""Run registered queries next to their SQL and compare rows: ``check_queries.py [sf_dir] [name...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from codeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, name: str) -> str:
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)} ({spark_s:.1f}s)"
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    took = f"({spark_s:.1f}s, sql {time.time() - started:.1f}s)"
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return f"ok {len(got)} {took}"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"DIFFERENT {len(got)} vs {len(want)} {took}\n   spark: {extra}\n   sql:   {missing}"


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(entry.queries())
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(directory)
    for query_name in chosen:
        try:
            print(query_name, compare(session, duck, directory, query_name), flush=True)
        except Exception as problem:
            print(query_name, "ERROR", type(problem).__name__, str(problem)[:700], flush=True)
