"""Run registered queries against their SQL checks: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return x + 0.0
    return x


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when rows agree (columns by name, order ignored), else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(cell(r[i]) for i in at) for r in theirs), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(order, a))} != {dict(zip(order, b))}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from fleetlife.workload import all_entries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = session(), connect(sf), []
    for name, e in all_entries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = e.run(spark, sf)
            if e.sql is None:
                problem, note = "", f"{df.count()} rows, no SQL"
            else:
                problem, note = compare(df, con, e.sql), "ok"
        except Exception as ex:
            problem, note = f"{type(ex).__name__}: {str(ex)[:600]}", ""
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
        if problem:
            bad.append(name)
    print("FAILED:" if bad else "all good", *bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
