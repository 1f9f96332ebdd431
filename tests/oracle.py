"""Compares queries with their SQL: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=4; SET preserve_insertion_order=false")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows and column names."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    names = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    want = rows_of(names, con.execute(sql).fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} rows and {len(want)}; only here {list(a - b)[:2]}, only in SQL {list(b - a)[:2]}"
    return "" if got else "no rows"


def session(threads: int = int(os.environ.get("THREADS", "8"))):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{threads}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    sf, *names = sys.argv[1:]
    queries, sqls = e.queries(), e.oracle_sql()
    spark, con = session(), views(sf)
    for name in names or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sqls[name], sf) if name in sqls else f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:400]}"
        print(f"{name} {time.time() - began:.1f} s {said or 'same'}", flush=True)
