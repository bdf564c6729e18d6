"""Run registered queries beside their SQL and compare by value.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, int) else v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, sf):
    """None when both results agree, else a text that says how they differ."""
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf)
    cols, rows = got.columns, got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(want_cols):
        return f"columns {sorted(cols)} / {sorted(want_cols)}"
    a, b = _rows(cols, rows), _rows(want_cols, want)
    if a == b:
        return None
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} / {len(b)} rows; first differences {diff}"


def main():
    from spendtide.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    import __spark_entry__ as entry

    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            bad = compare(spark, name, sf)
        except Exception as e:
            bad = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bad is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if bad else 'ok  '} {kind} {name} {time.time() - start:.1f}s {bad or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
