"""Runs registered queries against their SQL twins: check_queries.py [--sf DIR] [name part…]."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import compare, connect  # noqa: E402
from conftest import make_session  # noqa: E402


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf_dir = argv[at + 1]
        del argv[at:at + 2]
    import __spark_entry__ as entry
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(part in name for part in argv):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], sf_dir)
                state = "ok" if problem is None else "DIFF"
            else:
                rows = fn(spark, sf_dir).collect()
                problem, state = f"{len(rows)} rows", "rows" if rows else "EMPTY"
        except Exception as error:
            problem, state = f"{type(error).__name__}: {str(error)[:600]}", "FAIL"
        failed += state in ("DIFF", "FAIL", "EMPTY")
        print(f"{state:5} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
