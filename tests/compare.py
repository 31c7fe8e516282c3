"""Run registered queries next to their SQL twins in DuckDB and compare all values."""
from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(d):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def norm(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else (round(x, 6) + 0.0)
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    return str(x)


def compare(spark, con, name, q, d):
    """(message or '', rows, spark seconds, sql seconds)"""
    t0 = time.time()
    df = q.run(spark, d)
    rows = df.collect()
    t1 = time.time()
    cols = df.columns
    if q.sql is None:
        return "", len(rows), t1 - t0, None
    cur = con.execute(q.sql)
    sql_cols = [c[0] for c in cur.description]
    sql_rows = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(sql_cols):
        return f"columns {sorted(cols)} vs {sorted(sql_cols)}", len(rows), t1 - t0, t2 - t1
    a = Counter(tuple(norm(r[c]) for c in sorted(cols)) for r in rows)
    idx = [sql_cols.index(c) for c in sorted(cols)]
    b = Counter(tuple(norm(r[i]) for i in idx) for r in sql_rows)
    if a != b:
        x, y = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{len(rows)} vs {len(sql_rows)} rows; spark only {sum((a - b).values())}: {x}; sql only {sum((b - a).values())}: {y} [{sorted(cols)}]", len(rows), t1 - t0, t2 - t1
    return "", len(rows), t1 - t0, t2 - t1


def main():
    sys.path.insert(0, ".")
    from privtrace.plans import load
    from privtrace.session import local_session
    d = sys.argv[1]
    names = sys.argv[2:]
    spark, con = local_session(8), connect(d)
    bad = []
    for name, q in load().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) or n == q.run.__module__.split(".")[-1] for n in names):
            continue
        try:
            msg, n, s, t = compare(spark, con, name, q, d)
        except Exception as e:  # noqa: BLE001
            msg, n, s, t = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0, 0
        print(f"{'ok  ' if not msg else 'FAIL'} {name} rows={n} spark={s:.2f}s sql={'-' if t is None else f'{t:.2f}s'} {msg}", flush=True)
        if msg:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
