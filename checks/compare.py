"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.oracle import SQL
from checks.queries import QUERIES
from utterlake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value if math.isinf(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in SQL:
                print(f"rows  {name:26s} {sum(got.values()):8d} rows  {took:6.1f}s", flush=True)
                continue
            start = time.time()
            rel = con.execute(SQL[name])
            columns = [c[0] for c in rel.description]
            want = rows_of(columns, rel.fetchall())
            same = got == want and sorted(columns) == sorted(df.columns)
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'}  {name:26s} {sum(got.values()):8d} rows  {took:6.1f}s  duckdb {time.time() - start:6.1f}s", flush=True)
            if not same:
                print("   columns", sorted(df.columns), sorted(columns))
                for side, rest in (("spark", got - want), ("duckdb", want - got)):
                    print(f"   only {side}: {sum(rest.values())}", [str(r)[:300] for r in list(rest)[:2]])
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
