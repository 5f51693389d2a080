"""Compare every registered query that has a DuckDB twin with it at one scale.

    python tests/run_oracle.py /root/testdata/sf0.1 [query ...]
"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import __spark_entry__ as E  # noqa: E402
from harness import compare, duck  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark(shuffle_partitions=16)
    con = duck(sf)
    ok = True
    queries = E.queries()
    for name, sql in E.oracle_sql().items():
        if only and name not in only:
            continue
        t0 = time.time()
        r = compare(queries[name](spark, sf), con, sql)
        good = r["columns_match"] and r["values_match"] and r["spark_rows"] == r["oracle_rows"]
        ok &= good
        print(f"{'OK ' if good else 'BAD'} {name:24s} rows={r['spark_rows']:>8} {time.time() - t0:6.1f}s",
              flush=True)
        if not good:
            print("   ", r)
    sys.exit(0 if ok else 1)


if __name__ == "__main__":
    main()
