"""Run registered queries against their SQL: python tests/check.py [sf] [name ...]"""

import importlib
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as E  # noqa: E402
from oracle import compare, connect  # noqa: E402
from strandmill.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            if name in sql:
                err = compare(fn(spark, sf_dir), con, sql[name])
            else:
                err = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:600]}"
        bad += err is not None
        print(f"{'ok ' if err is None else 'BAD'} {name} {time.time()-t:.1f}s {err or ''}", flush=True)
    print("failures:", bad)


main()
