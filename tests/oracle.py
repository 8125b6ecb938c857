"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/oracle.py [scale] [name ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)}", took
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", took
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} e.g. {sorted(df.columns)}: {bad[0][0]} | {bad[0][1]}", took
    return f"ok {len(a)}", took


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


if __name__ == "__main__":
    from tabwise.session import session

    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, took = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:
            verdict, took = f"ERROR {type(e).__name__}: {str(e)[:400]}", 0.0
        print(f"{name:32s} {took:6.2f}s {verdict[:700]}", flush=True)
