"""Run every registered query and its SQL equivalent and compare whole results.

Usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}


def kinds_differ(df, relation):
    want = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in relation.description}
    return {name: (kind, want[name]) for name, kind in df.dtypes if want[name] != kind}


def compare(spark, con, run, sql, folder):
    df = run(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    if set(df.columns) == {d[0] for d in relation.description} and kinds_differ(df, relation):
        return f"types {kinds_differ(df, relation)}", len(got[1])
    want = normal([d[0] for d in relation.description], relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1])
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}", len(got[1])
    return None, len(got[1])


if __name__ == "__main__":
    import __spark_entry__ as e
    from shelfline.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:]
    spark = build_session("check", master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(oracles)), "without query:", sorted(set(oracles) - set(queries)))
    bad = 0
    for name in chosen or [n for n in queries if n in oracles]:
        start = time.time()
        try:
            problem, rows = compare(spark, con, queries[name], oracles[name], folder)
        except Exception as failure:  # noqa: BLE001
            problem, rows = f"{type(failure).__name__}: {str(failure)[:600]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={rows} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
