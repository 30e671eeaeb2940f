"""Run registered queries on Spark and DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: repr(r))


def compare(spark, con, q, folder):
    """(ok, message, seconds)"""
    from candlewick.plans.registry import runner
    t0 = time.time()
    df = runner(q)(spark, folder)
    rows = df.collect()
    took = time.time() - t0
    if q.sql is None:
        return True, f"{len(rows)} rows, no SQL", took
    cur = con.execute(q.sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    cols, got = canonical(df.columns, rows)
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}", took
    if len(got) != len(want):
        return False, f"{len(got)} rows, wanted {len(want)}", took
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        diffs = [(c, x, y) for c, x, y in zip(cols, *bad[0]) if repr(x) != repr(y)]
        return False, f"{len(bad)} of {len(got)} rows differ: {diffs[:3]} in {bad[0][0][:4]}", took
    return True, f"{len(got)} rows", took


def main(argv):
    from candlewick.session import build_session
    import __spark_entry__  # noqa: F401  registers the queries
    from candlewick.plans.registry import QUERIES
    folder = argv[0]
    names = argv[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "8g",
                                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for pattern in names:
        for name in [n for n in QUERIES if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]:
            try:
                ok, message, took = compare(spark, con, QUERIES[name], folder)
            except Exception as e:  # report and go on
                ok, message, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
                if "stopped SparkContext" in message or "OutOfMemory" in message:
                    raise SystemExit(message)
            failed += not ok
            print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {message}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
