"""Run registered queries next to their SQL in DuckDB: python tests/check_oracles.py [prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark_df, con, sql: str) -> str:
    """Empty string when both sides are equal value by value, else the first difference."""
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    guard = threading.Timer(40, con.interrupt)
    guard.start()
    try:
        res = con.execute(sql)
        want_rows = res.fetchall()
    finally:
        guard.cancel()
    want_cols = [c[0] for c in res.description]
    want = rows_of(want_cols, want_rows)
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from lossbook.session import build_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else f"({len(df.collect())} rows, no SQL)"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good = not problem or problem.endswith("no SQL)")
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
