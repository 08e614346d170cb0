"""Compare registered queries with their oracle SQL: python tests/oracle.py [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def norm(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.5f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, queries, oracles):
    start = time.time()
    df = queries[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    print(f"[{time.time() - start:.1f}s spark]", end=" ")
    if name not in oracles:
        return f"rows-only {len(got)}"
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} duck={sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if got == want:
        return f"ok {len(got)}" if got else "EMPTY"
    a, b = set(got) - set(want), set(want) - set(got)
    return f"DIFF {sorted(columns)} spark={len(got)} duck={len(want)}\n   spark only: {sorted(a)[:3]}\n   duck only:  {sorted(b)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from intel_spark.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if len(sys.argv) == 1 or any(name.startswith(p) for p in sys.argv[1:]):
            start = time.time()
            try:
                verdict = compare(spark, con, name, queries, oracles)
            except Exception as error:  # report and go on to the next query
                verdict = "ERROR " + str(error)[:900]
            print(f"{name:40s} {time.time() - start:5.1f}s {verdict}", flush=True)
