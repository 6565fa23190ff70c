"""Run queries against their DuckDB statements: same columns, same rows.

    python tests/oracle.py sf0.01 [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__[0]}{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    """Difference as text, or None when both sides agree."""
    df = fn(spark, folder)
    got_names = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    exp_names = [d[0] for d in cur.description]
    exp = cur.fetchall()
    if sorted(got_names) != sorted(exp_names):
        return f"columns {sorted(got_names)} != {sorted(exp_names)}", len(got)
    a, b = rows_of(got_names, got), rows_of(exp_names, exp)
    if a == b:
        return None, len(got)
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return (f"rows {len(a)} vs {len(b)}\n   cols  {sorted(got_names)}\n   spark {str(only_a)[:1500]}"
            f"\n   duck  {str(only_b)[:1500]}"), len(got)


def main() -> int:
    import __spark_entry__ as entry
    from docketlake.session import build_session

    folder = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                diff, n = compare(spark, con, fn, oracle[name], folder)
            else:
                diff, n = None, fn(spark, folder).count()
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {name} rows={n} {time.time() - t:.1f}s"
              + ("" if diff is None else f"\n   {diff}"), flush=True)
        bad += diff is not None
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
