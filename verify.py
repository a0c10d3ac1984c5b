"""Compare queries with their SQL on one data folder: python verify.py [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from mixledger.plans import all_queries, all_sql
from mixledger.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else round(number, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, sql = all_queries(), all_sql()
    names = sys.argv[1:] or list(queries)
    if os.environ.get("PLAIN"):
        # A session as a caller may bring it, without the settings of ``local_session``.
        builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        spark = builder.config("spark.driver.memory", "8g").getOrCreate()
    else:
        spark = local_session("verify")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(mine[1])} {took:.1f}s", flush=True)
                continue
            cursor = db.execute(sql[name])
            theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
            same = mine == theirs
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name} {len(mine[1])} {took:.1f}s", flush=True)
            if not same:
                print("  columns", mine[0], theirs[0], "rows", len(mine[1]), len(theirs[1]))
                a, b = set(mine[1]), set(theirs[1])
                print("  spark only", sorted(a - b, key=repr)[:3])
                print("  sql only  ", sorted(b - a, key=repr)[:3])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
