"""Compare registered queries with their SQL on the driver tables: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(float(v)) if v % 1 else str(int(v))
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)}", took, True
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", took, False
    order = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return f"same {len(got)}", took, True
    lost, extra = list(set(want) - set(got)), list(set(got) - set(want))
    return f"DIFF rows {len(got)} vs {len(want)}; {cols}; not found {sorted(lost)[:3]}; extra {sorted(extra)[:3]}", took, False


def main():
    from tracewright.session import session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in e.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            said, took, fine = compare(spark, con, name, fn, e.oracle_sql().get(name), sf_dir)
        except Exception as x:
            said, took, fine = f"ERROR {type(x).__name__}: {str(x)[:700]}", 0.0, False
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {name:24s} {took:6.2f}s {said}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
