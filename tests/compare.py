"""Runs each query and its SQL side by side: `python -m tests.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from tidemark.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def _table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def spark_table(df):
    return _table([tuple(r) for r in df.collect()], df.columns)


def duck_table(con, sql):
    result = con.sql(sql)
    return _table(result.fetchall(), result.columns)


# DuckDB names of the Spark types in use.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def spark_types(df):
    return {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}


def duck_types(con, sql):
    result = con.sql(sql)
    return dict(zip(result.columns, map(str, result.types)))


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__log__level="ERROR"
    )
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name not in oracles:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            got = spark_table(df)
            took = time.time() - start
            want = duck_table(con, oracles[name])
            types = spark_types(df), duck_types(con, oracles[name])
        except Exception as error:  # show and go on
            print(f"FAIL {name}: {str(error)[:600]}")
            bad += 1
            continue
        same = got == want and types[0] == types[1]
        print(f"{'ok  ' if same else 'DIFF'} {name} rows={len(got[1])} {took:.2f}s", flush=True)
        if not same:
            bad += 1
            print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            different = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
            for a, b in different:
                print("   spark ", a)
                print("   oracle", b)
            print("   types", set(types[0].items()) ^ set(types[1].items()))
    missing = set(entry.queries()) ^ set(oracles)
    print("bad:", bad, "without partner:", sorted(missing))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
