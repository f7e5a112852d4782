"""Run registered queries beside their SQL: python tests/oracle_check.py [sf_dir] [name-part ...]."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set threads=4")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=str)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    return str(value)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short reason."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    rows = df.collect()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    order = sorted(cols)
    pick = [cols.index(c) for c in order]
    have = sorted(tuple(canonical(r[c]) for c in order) for r in rows)
    want = sorted(tuple(canonical(r[i]) for i in pick) for r in want_rows)
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}"
    if not have:
        return "both sides are empty"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        return f"{len(bad)}/{len(have)} rows differ in {order}: {bad[:3]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from pixelwarrant.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = oracle_sql()
    failed = 0
    for name, build in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(build(spark, sf), con, sqls[name])
                kind = "sql"
            else:
                problem = None if build(spark, sf).count() > 0 else "no rows"
                kind = "rows"
        except Exception as exc:  # a failed query must not hide the others
            problem, kind = f"{type(exc).__name__}: {str(exc)[:700]}", "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:5s} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
