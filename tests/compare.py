"""Run check queries on Spark and DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from corpusgraph.plans.inputs import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message, seconds, rows)"""
    t = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, "rows only", took, len(rows)
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns {sorted(cols)} vs {sorted(ocols)}", took, len(rows)
    a, b = bag(cols, rows), bag(ocols, orows)
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(rows)} vs {len(orows)} rows; only spark {sum((a - b).values())}: {str(left)[:700]}; only oracle {sum((b - a).values())}: {str(right)[:700]}", took, len(rows)
    return True, "match", took, len(rows)


def main(argv):
    from corpusgraph.session import local_session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or name.startswith(n.rstrip("*")) and n.endswith("*") for n in names):
            continue
        try:
            ok, message, took, n = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, message, took, n = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {n:7d} {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
