"""Run queries beside their SQL counterparts: python tests/compare.py [dir] [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    ours = normal_rows(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = normal_rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    diff = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(diff)} of {len(ours)} rows differ, first {diff[0]}" if diff else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from driftwatch.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    con = duck(sf_dir)
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracle_sql():
                verdict = compare(spark, con, query, oracle_sql()[name], sf_dir) or "equal"
            else:
                verdict = f"{query(spark, sf_dir).count()} rows"
        except Exception as error:  # keep going: this is a report
            verdict = f"ERROR {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)
