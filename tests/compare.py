"""Run registered queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return f"{value:.6f}" if isinstance(value, float) else str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """(problem or None, rows)."""
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = rows_of(want_names, res.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(a[:300], b[:300]) for a, b in zip(g, w) if a != b]
        return f"{len(bad)} rows differ, e.g. {g[0][:40]}: {cells[:2]}", len(got)
    return None, len(got)


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from diffloom.session import build_session

    spark = build_session(f"local[{os.environ.get('CORES', 8)}]", spark_ui_enabled="false", spark_driver_memory="12g",
                          spark_sql_shuffle_partitions="8",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not names or any(n.startswith(x.rstrip('*')) if x.endswith('*')
                 else n == x for x in names)]:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:7d} rows {time.time() - t:6.1f}s "
              f"{'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
