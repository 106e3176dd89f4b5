"""Run registered queries against DuckDB: ``python -m tests.oracle [prefix ...] [--sf 0.01]``."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got={got[:2]} want={want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    kinds = [
        (c, {kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None})
        for i, c in enumerate(got_cols)
    ]
    off = [k for k in kinds if k[1] != k[2]]
    if off:
        return f"types differ {off}"
    return None if got else "EMPTY"


def main(argv: list[str]) -> int:
    from apexframe import plans
    from apexframe.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    queries, sqls = plans.queries(), plans.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.split("_")[0] == p or (p.isalpha() and name.rstrip().startswith(p) and name[len(p)].isdigit()) or (len(p) > 3 and name.startswith(p)) for p in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = df.count()
                problem = None if n else "EMPTY"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - t0
        mark = "ok  " if problem is None else "FAIL"
        note = "" if name in sqls else " (rows only)"
        if problem or argv or took > 4:
            print(f"{mark} {name} {took:.1f}s{note} {problem or ''}", flush=True)
        failed += problem is not None
    print("failed", failed, "of", len(queries), "sql", len(sqls))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
