"""Compare every registered query with its SQL twin on one data folder.

usage: python tests/parity.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return True, f"rows={len(rows)} (no SQL twin)", spent
    start = time.time()
    cur = con.execute(sql)
    expected = cur.fetchall()
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    duck = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", spent
    odd = [
        f"{c}:{t}/{types[c]}" for c, t in df.dtypes if TYPES.get(t) != types[c]
    ]
    mine, theirs = normal(rows, df.columns), normal(expected, names)
    if mine != theirs:
        only_a = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 20000 else mine[:2]
        only_b = [r for r in theirs if r not in set(mine)][:3] if len(theirs) < 20000 else theirs[:2]
        return False, f"{len(mine)} vs {len(theirs)} rows; cols {sorted(names)}\n   spark {only_a}\n   sql   {only_b}", spent
    if odd:
        return False, f"types {odd}", spent
    return True, f"rows={len(rows)} duck={duck:.1f}s", spent


def main(argv):
    import __spark_entry__ as entry
    from lectern.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note, spent = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            ok, note, spent = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {spent:.1f}s {note}", flush=True)
    print(f"bad={bad}")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
