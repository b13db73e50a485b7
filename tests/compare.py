"""Runs queries and their SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def differ(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    other = rows_of(rel.columns, rel.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} rows and {len(other)}"
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    return f"{len(bad)} of {len(mine)} rows, first {bad[0]}"[:1500] if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as entry
    from millrace.session import session

    sf = f"/root/testdata/{sys.argv[1]}"
    only = sys.argv[2:]
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only or not only and name not in sqls:
            continue
        t = time.time()
        try:
            said = differ(spark, con, run, sqls[name], sf) or "ok"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
