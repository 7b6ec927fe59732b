"""Run registered queries on Spark and their SQL on DuckDB and compare rows.

usage: python tests/compare.py [sf] [prefix ...]
"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    return f"{type(v).__name__}:{v}" if not isinstance(v, str) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, sf_dir, key, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(names, want)
    if ca != cb:
        return "COLUMNS", len(got), took, f"spark={ca}\n duck={cb}"
    if a != b:
        sa, sb = set(a), set(b)
        extra, miss = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        diff = ""
        if extra and miss:
            diff = "first diff cols: " + str([(c, x, y) for c, x, y in zip(ca, extra[0], miss[0]) if x != y])
        return "DIFF", len(got), took, f"rows {len(a)} vs {len(b)}, differing {len(sa - sb)}/{len(sb - sa)}\n S={extra[:2]}\n D={miss[:2]}\n {diff}"
    return "ok", len(got), took, ""


def session():
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master("local[8]").appName("compare")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    con, spark = duck(sf_dir), session()
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = entry.oracle_sql(), []
    keys = [k for k in entry.queries() if k.startswith(prefixes)]
    empty = []
    for key in keys:
        try:
            state, n, took, note = compare(spark, con, sf_dir, key, entry.queries()[key], oracles.get(key))
        except Exception as e:
            state, n, took, note = "ERROR", -1, 0, str(e)[:900]
        if n == 0:
            empty.append(key)
        if state not in ("ok", "rows-only"):
            bad.append(key)
        if state != "ok" or took > 4 or n == 0:
            print(f"{state:9} {key:42} rows={n} {took:.1f}s {note}", flush=True)
    print(f"{len(keys)} queries, {len(bad)} bad {bad}, empty {empty}")
