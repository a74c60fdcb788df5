"""Run registered queries and compare them with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return "rows", len(got), None, took, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), len(want), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return "ok", len(a), len(b), took, ""
    sa, sb = set(map(str, a)), set(map(str, b))
    only_a = [x for x in a if str(x) not in sb][:2]
    only_b = [x for x in b if str(x) not in sa][:2]
    return "DIFF", len(a), len(b), took, f"\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("mnemolake")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:]

    def late(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, late)
    bad = 0
    for name, fn in qs.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "60")))
        try:
            st, n, m, took, msg = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            st, n, m, took, msg = "ERROR", 0, 0, 0.0, str(e)[:1500]
        signal.alarm(0)
        if st == "ERROR":
            spark.sparkContext.cancelAllJobs()
        bad += st not in ("ok", "rows")
        print(f"{st:8s} {name:36s} {n} {m} {took:.2f}s {msg}", flush=True)
    print("bad:", bad)
