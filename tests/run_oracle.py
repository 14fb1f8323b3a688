"""Compare every registered query with its oracle SQL (what the driver's gate does).

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck_connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from murmur.session import local_session  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session()
    con = duck_connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                n = df.count()
                ok, msg = True, f"rows-only ({n} rows)"
        except Exception as e:  # report and keep going
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
