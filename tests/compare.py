"""Compare a Spark result with its SQL oracle, order-insensitively."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, bool):
        return v
    if v is not None and not isinstance(v, (int, str)):
        return float(v) if v.__class__.__name__ == "Decimal" else str(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def check(spark, con, name, fn, sql, sf_dir):
    """Return (ok, message, n_rows)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return bool(got), f"rows only: {len(got)} rows, {t1 - t0:.1f}s", len(got)
    rel = con.execute(sql)
    desc = [d[0] for d in rel.description]
    kinds = {d[0]: KIND.get(str(d[1]), str(d[1])) for d in rel.description}
    want, wc = rows_of(desc, rel.fetchall())
    t2 = time.time()
    msg = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"columns {gc} vs {wc}", len(got)
    bad = {c: (t, kinds[c]) for c, t in df.dtypes if t != kinds[c]}
    if bad:
        return False, f"types (spark, sql) {bad}; {msg}", len(got)
    if got != want:
        s, w = set(map(repr, got)), set(map(repr, want))
        a, b = sorted(s - w), sorted(w - s)
        return False, f"{msg}; sql rows {len(want)}; diff {len(a)}/{len(b)}\n   {gc}\n   spark {a[:2]}\n   sql   {b[:2]}", len(got)
    if not got:
        return False, "both empty", 0
    return True, msg, len(got)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from tidemark.plans import ORACLE, QUERIES
    from tidemark.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8", 8)
    con = connect(sf)
    failed = 0
    for n in names:
        try:
            ok, msg, _ = check(spark, con, n, QUERIES[n], ORACLE.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", n, msg, flush=True)
    print("failed:", failed, "of", len(names))
