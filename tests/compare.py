"""Runs registered queries beside their oracle SQL and compares sorted rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return f"decimal {v}"
    if isinstance(v, dict) or hasattr(v, "asDict"):
        d = v.asDict() if hasattr(v, "asDict") else v
        return tuple(sorted((k, _norm(x)) for k, x in d.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_norm(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def check(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return len(got), f"{sorted(names)} {str(x)[:300]} vs {str(y)[:300]}"
        if [type(i) for i in x] != [type(i) for i in y] and None not in x + y:
            return len(got), f"types {[type(i).__name__ for i in x]} vs {[type(i).__name__ for i in y]}"
    return len(got), None


def main() -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1]
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name in qs:
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            n, problem = check(spark, con, qs[name], os_.get(name), sf_dir)
        except Exception as ex:  # report and go on
            n, problem = -1, f"{type(ex).__name__}: {str(ex)[:600]}"
        mark = "FAIL" if problem else ("ok" if name in os_ else "rows")
        bad += bool(problem)
        print(f"{mark:5}{name:40}{n:8} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
