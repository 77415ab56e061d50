"""Run Spark queries and their SQL twins side by side.

Usage: python tests/compare.py [sf-dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return "b" + str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "f" + repr(v)
    if isinstance(v, int):
        return "i" + str(v)
    return type(v).__name__ + str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf):
    df = q.fn(spark, sf)
    got_cols, got = canon(df.columns, df.collect())
    if not q.sql:
        return f"rows-only {len(got)}"
    cur = con.execute(q.sql)
    want_cols, want = canon([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"FAIL columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"FAIL {len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]} cols {got_cols}"
    return f"ok {len(got)}"


def main(argv):
    from slopecast.plans import all_queries
    from slopecast.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = duck(sf)
    names = argv[1:]
    qs = all_queries()
    picked = [q for n, q in qs.items() if not names or n in names or any(q.fn.__module__.endswith(x) for x in names)]
    fails = 0
    for q in picked:
        t0 = time.time()
        try:
            res = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001
            res = "FAIL " + type(e).__name__ + " " + str(e)[:600]
        spark.catalog.clearCache()
        fails += res.startswith("FAIL")
        print(f"{time.time() - t0:6.1f}s {q.name:32s} {res}", flush=True)
    print(f"{len(picked)} queries, {fails} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
